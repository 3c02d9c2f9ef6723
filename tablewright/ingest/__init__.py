"""Landed dashboard payloads to indexed chart patterns."""
