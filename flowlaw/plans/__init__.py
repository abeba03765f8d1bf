"""Whole jobs: discovery from a table, sweeps and their reports, and the registered queries."""
