"""Sparse log-linear scoring and the shift-reduce parser of questions."""
