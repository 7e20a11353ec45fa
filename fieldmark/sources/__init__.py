"""Readers and writers of tables and transcripts."""
