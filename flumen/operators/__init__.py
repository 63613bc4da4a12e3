"""Operators over blocks and packets that the query front end does not cover."""
