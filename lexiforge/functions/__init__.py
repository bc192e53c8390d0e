"""Part of lexiforge; see README.md."""
