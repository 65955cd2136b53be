"""Registered queries over the test tables, each beside an independent SQL statement."""
