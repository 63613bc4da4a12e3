"""Packets to flows with Structured Streaming."""
