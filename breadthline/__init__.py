"""Market-structure analytics for daily price and volume bars, as Spark DataFrame jobs."""
