"""Part of regesta; see the README."""
