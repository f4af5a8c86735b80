"""Helpers that shape physical plans: lineage cuts and joins on skewed keys."""

from corpusloom.plans.lineage import clear, cut, shared_dir
from corpusloom.plans.spread import spread
from corpusloom.plans.skew import hot_keys, lookup_join

__all__ = ["clear", "cut", "hot_keys", "lookup_join", "shared_dir", "spread"]
