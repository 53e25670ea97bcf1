"""Structured Streaming jobs; all of them can run to completion and be run again."""
