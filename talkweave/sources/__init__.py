"""Readers and writers of exports and message tables."""
