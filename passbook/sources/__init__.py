"""Readers of event logs, command files and balance tables."""
