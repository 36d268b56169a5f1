"""Queries over the test tables."""

from sigloom.plans import catalogue, extended

__all__ = ["catalogue", "extended"]
