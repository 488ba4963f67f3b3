"""Registered queries over the fixture views and their SQL twins."""
