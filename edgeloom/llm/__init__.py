"""Operators for large text corpora: cleaning, de-duplication, tokenisation."""
