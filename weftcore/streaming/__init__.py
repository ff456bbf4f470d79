"""weftcore.streaming."""
