"""Structured Streaming jobs and the batch forms of their state machines."""
