"""Queries over the driver's tables, with the same in SQL, and checks of plans."""
