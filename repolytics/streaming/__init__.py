"""Structured Streaming versions of the incremental and stateful operators."""
