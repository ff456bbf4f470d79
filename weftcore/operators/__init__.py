"""weftcore.operators."""
