"""Operators that Spark has no single function for: exact ranks of large groups, joins as of a date, merges."""
