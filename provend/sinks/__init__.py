"""Report sink: one Parquet / CSV table per non-empty result."""
