"""Part of terrane; see README."""
