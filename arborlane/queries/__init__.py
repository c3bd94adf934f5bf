"""Registered queries over the driver's tables, each with the same in SQL where SQL can express it."""
