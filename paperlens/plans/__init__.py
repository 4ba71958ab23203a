"""Registered queries: each applies operators of the library to the driver's tables, beside SQL for the same rows."""
