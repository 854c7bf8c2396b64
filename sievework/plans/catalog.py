"""All queries of the curation library, by name, with their SQL."""

from __future__ import annotations

from sievework.plans import canonical, composed, curation, evaluation, extraction, keys, mapping, merging, promotion, rules, serving  # noqa: F401
from sievework.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "ag02_index_coverage"
