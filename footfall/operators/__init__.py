"""footfall.operators."""
