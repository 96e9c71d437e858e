"""Search and media-indexing analytics on Spark."""
