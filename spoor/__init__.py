"""Spoor: memory-forensics evidence analytics as DataFrame jobs."""
