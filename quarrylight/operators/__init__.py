"""Operators on findings, files and graphs."""
