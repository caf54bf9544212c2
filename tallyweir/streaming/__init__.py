"""Structured Streaming forms of the rollups and of the pane operator."""
