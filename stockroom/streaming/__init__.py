"""Structured Streaming jobs: refresh loop and quantity event streams."""

from .streams import (REFRESH_INTERVAL, file_stream, run_available, stream_apply_events, stream_net_quantity,
                      stream_summary)

__all__ = [n for n in dir() if not n.startswith("_")]
