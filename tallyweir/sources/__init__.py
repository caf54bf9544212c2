"""Readers: tables by name, and text lines of observations with their rejects."""
