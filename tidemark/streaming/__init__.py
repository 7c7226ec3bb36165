"""Structured Streaming twins of the batch operators."""

from tidemark.streaming.operators import completed, deduplicated, events_stream, progress_of, run_available, session_windows, sliding_windows, text_sessions, tumbling_windows

__all__ = ["completed", "deduplicated", "events_stream", "progress_of", "run_available", "session_windows", "sliding_windows", "text_sessions", "tumbling_windows"]
