"""Spark-native analytics over crawled sites: tables of URLs, links, pages and documents."""
