"""Queries over the test tables, with their SQL."""

from millrace.plans import models, queries, records  # noqa: F401
