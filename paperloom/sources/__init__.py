"""Readers and intake checks: tables, files, encodings, journals, sheets."""
