"""Edges, node numbers and PageRank."""
