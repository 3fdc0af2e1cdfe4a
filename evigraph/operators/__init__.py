"""Operators over the tables of an evidence graph."""
