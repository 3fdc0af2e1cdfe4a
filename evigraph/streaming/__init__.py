"""Stateful operators over event streams."""
