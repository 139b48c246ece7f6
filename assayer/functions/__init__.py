"""Part of assayer."""
