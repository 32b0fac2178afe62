"""footfall.functions."""
