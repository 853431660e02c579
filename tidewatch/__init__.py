"""Market-microstructure stress analytics on Spark."""
