"""Panels, files and ledgers that are read and written."""
