"""Analytics over versioned file manifests and content-addressed storage, as Spark DataFrames."""
