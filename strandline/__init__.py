"""Spark-native analytics for web-search data: text, postings, link graph, ranking, crawl policy."""
