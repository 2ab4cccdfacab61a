"""Security analytics over source lines, recorded responses, crawled pages and scan history, on Spark."""
