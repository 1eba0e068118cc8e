"""Structured Streaming: scored prediction log and its live window."""
