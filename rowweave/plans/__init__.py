"""Schemas and what is planned from them on the driver: no data is touched here."""
