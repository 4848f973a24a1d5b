"""Structured Streaming: turns of logs that are still being written."""

from histlake.streaming.turns import read_stream, stream_turns, write_once

__all__ = ["read_stream", "stream_turns", "write_once"]
