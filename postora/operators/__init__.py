"""Operators over an index: search, scores, statistics, maintenance."""
