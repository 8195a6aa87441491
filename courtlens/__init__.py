"""Roster, team and school analytics on Spark."""
