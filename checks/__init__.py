"""Test inputs derived from the driver's tables, named queries and their SQL twins."""
