"""Connectors over recorded payloads, file scans and sinks."""
