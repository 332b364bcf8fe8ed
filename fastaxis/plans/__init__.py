"""Queries over the driver tables with their SQL, and the pick pipeline."""
