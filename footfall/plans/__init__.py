"""footfall.plans."""
