"""Relational operators: alignment, counting, information measures, selection."""
