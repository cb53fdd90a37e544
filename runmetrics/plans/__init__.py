"""Composed jobs: the tables derived from the driver's data, reports, and the query catalog."""
