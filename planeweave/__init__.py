"""Control-plane analytics over many capture runs, written as Spark DataFrame operations."""
