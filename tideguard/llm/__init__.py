"""Operators for building training data from a corpus. Nothing else in the package imports this."""
