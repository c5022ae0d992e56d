"""The same row-wise operators over unbounded tables."""

from karstline.streaming.stream import read_stream, start

__all__ = ["read_stream", "start"]
