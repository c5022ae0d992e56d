"""Where tables come from and go to."""

from karstline.sources.ingest import from_arrow, from_rows, read_parquet, write_parquet

__all__ = ["from_arrow", "from_rows", "read_parquet", "write_parquet"]
