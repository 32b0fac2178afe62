"""footfall.sources."""
