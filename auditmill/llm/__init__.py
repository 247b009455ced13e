"""Operators that prepare training data from crawled texts and measurements."""
