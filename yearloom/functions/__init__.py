"""Part of yearloom."""
