"""Whole plans: a feed derived from the driver's tables, and the queries registered on it."""
