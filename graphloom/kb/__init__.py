"""Queries of the term language over a table of triples."""

from graphloom.kb.base import KnowledgeBase

__all__ = ["KnowledgeBase"]
