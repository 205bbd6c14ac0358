"""Readers of the feeds: raw payloads to typed rows and rejections."""
