"""Registered queries: operators bound to the given tables, each with the SQL that checks it."""
