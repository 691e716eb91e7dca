"""Readers and writers of collection, topic, judgment and run files."""
