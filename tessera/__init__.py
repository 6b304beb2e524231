"""Analytics over a content-addressed object catalog, as Spark DataFrame and SQL operations."""
