"""Notewright: a PySpark-native engine for symbolic-music event data."""
