"""Operators for large training corpora: tokenizing, de-duplication, mixing, scanning and media columns."""
