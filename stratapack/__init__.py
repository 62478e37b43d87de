"""stratapack: content-addressed dataset compaction and its analytics on Spark."""
