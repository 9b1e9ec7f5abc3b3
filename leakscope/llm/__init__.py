"""Operators that prepare training data: overlaps, rankings, tokens, mixtures and page quality."""
