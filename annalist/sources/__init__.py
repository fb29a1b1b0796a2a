"""Readers of text formats into canonical entries, and the sinks they are written to."""
