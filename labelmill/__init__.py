"""Labelled-text data work on Spark: curate, split, encode, train, score, evaluate."""
