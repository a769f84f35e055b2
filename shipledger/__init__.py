"""shipledger: which component version shipped in which release, as Spark jobs."""
