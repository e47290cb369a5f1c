"""Operators bound to tables, with SQL that gives the same rows."""
