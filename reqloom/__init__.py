"""Review-transcript topics and requirement evidence on Spark."""
