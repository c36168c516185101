from .ingest import read_streamed, stream_table

__all__ = ["read_streamed", "stream_table"]
