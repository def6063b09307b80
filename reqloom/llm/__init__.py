"""Training-data operators for very large corpora, and the queries that apply them."""
