"""weftcore.sources."""
