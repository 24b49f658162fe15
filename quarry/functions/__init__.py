"""Part of quarry; see README."""
