"""Operators bound to the sample tables, each with the SQL that checks it."""
