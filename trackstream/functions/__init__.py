"""Part of trackstream."""
