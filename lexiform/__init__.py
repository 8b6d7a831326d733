"""Exact, stateful subword tokenization of corpora and conversations on Spark."""
