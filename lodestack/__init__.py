"""Web-search analytics on Spark: key-value tables, bags and pairs, crawling, ranked retrieval."""
