"""footfall: facility accessibility and closure impact on Spark."""
