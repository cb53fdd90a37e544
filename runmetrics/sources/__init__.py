"""Readers of run logs and definitions, and writers of tables and reports."""
