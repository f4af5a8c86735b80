"""All queries outside the subpackage for training text, with their SQL."""

from __future__ import annotations

from corpusloom.queries import integrity, pipeline, reference

QUERIES = {**integrity.QUERIES, **reference.QUERIES, **pipeline.QUERIES}
ORACLE = {**integrity.ORACLE, **reference.ORACLE, **pipeline.ORACLE}
