"""Queries: their language, their expression trees, and how a tree becomes columns."""
