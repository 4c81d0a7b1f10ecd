"""Web-index analytics on Spark: declarative DataFrame operators for crawl, search and text data."""
