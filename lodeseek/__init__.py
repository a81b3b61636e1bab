"""Identity-scoped retrieval over data catalogs and document collections, on Spark."""
