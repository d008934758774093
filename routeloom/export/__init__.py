"""Document builders and merges. Rows come aggregated from Spark; one document is assembled on the driver."""
