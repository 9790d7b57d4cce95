"""Grid time-series analytics on Spark: fixed per-series time grids, quality
bytes, last-write-wins slots and foldable block summaries."""
