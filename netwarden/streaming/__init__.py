"""Structured Streaming forms of detection and the live dashboard panels."""
