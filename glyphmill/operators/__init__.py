"""Part of glyphmill."""
