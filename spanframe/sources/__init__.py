"""Readers and writers of span-annotated records."""
