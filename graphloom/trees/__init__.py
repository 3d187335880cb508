"""Phrase-structure trees as bracketed text and as tables of nodes."""
