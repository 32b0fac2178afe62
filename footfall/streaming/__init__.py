"""footfall.streaming."""
