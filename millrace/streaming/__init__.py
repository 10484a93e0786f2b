"""Structured Streaming: built-in event-time windows, and the folds as stateful operators."""
