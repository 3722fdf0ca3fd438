"""Readers: change records, code, dependency files, changelogs, vendor tables."""
