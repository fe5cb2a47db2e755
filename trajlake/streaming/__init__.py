"""Structured Streaming: group completion, resumable appends, windowed rollout metrics."""
