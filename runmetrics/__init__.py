"""Analytics over pipeline run logs, expressed as Spark DataFrame jobs."""
