"""Offer search, extraction and comparison over tables of crawled pages, on Spark."""
