"""Suites, profiles, monitors, incidents and importers, planned as DataFrame jobs."""
