"""weftcore.functions."""
