"""Part of the granary engine; see README.md."""
