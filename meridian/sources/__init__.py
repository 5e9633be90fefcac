"""Readers that turn stored tables into the long panel model, and writers for results."""
