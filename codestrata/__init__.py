"""codestrata: repository analytics as Spark queries (see README.md)."""
