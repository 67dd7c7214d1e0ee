"""Relational operators as DataFrame compositions, each with a query that shows it."""
