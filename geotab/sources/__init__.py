"""Readers and writers of files and decoded tables."""
