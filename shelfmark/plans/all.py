"""Importing this registers every query."""

from shelfmark.plans import flows, lifecycle, mining, relational, scalar, search  # noqa: F401
