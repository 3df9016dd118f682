"""Analytics over imaging-derived time series, as Spark jobs."""
