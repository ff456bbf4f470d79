"""weftcore.plans."""
