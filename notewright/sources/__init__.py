"""Readers and writers: Standard MIDI Files, corpus tables, surrogate views."""
