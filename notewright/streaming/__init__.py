"""Incremental ingest of arriving MIDI files (an extension)."""
