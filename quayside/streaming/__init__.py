"""Watching folders and event logs with Structured Streaming."""
