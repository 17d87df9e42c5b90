"""Whole jobs: the reports, the histories and the loads."""
