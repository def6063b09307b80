"""Part of the review-evidence engine."""
