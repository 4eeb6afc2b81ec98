"""Part of scoria."""
