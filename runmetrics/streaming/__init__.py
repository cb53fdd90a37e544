"""Streaming versions of the totals, period metrics, retention and reports."""
