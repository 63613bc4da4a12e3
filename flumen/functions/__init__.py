"""Scalar functions: addresses, protocols, times, humanised numbers."""
