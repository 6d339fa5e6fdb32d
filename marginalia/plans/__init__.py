"""Queries over the operators, each with SQL for the same rows."""
