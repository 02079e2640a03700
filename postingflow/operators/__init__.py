"""The index, search over it, text ranges and scores."""
