"""Readers and writers of trajectory tables."""
