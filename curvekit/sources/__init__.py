"""Readers and writers of run records, results, fit documents and labelled text."""
