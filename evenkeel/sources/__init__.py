"""Readers and writers for sample tables, run results and checkpoint logs."""
