"""Registered queries over the project's tables and the SQL they are checked against."""
