"""weirflow: durable ordered feeds and content-addressed data, computed with Spark."""
