"""Readers and writers: folders, spreadsheets, statements, tables."""
