"""Operators that prepare corpora as training data. Nothing else in the library imports them."""
