"""Query plans over the star-schema tables. Each re-expresses what an operator means on them."""

from __future__ import annotations

from lodestrand.plans import attribution, fingerprints, instrument, relational, six_numbers
from lodestrand.plans.registry import Query

REGISTRY: list[Query] = [*relational.QUERIES, *fingerprints.QUERIES, *attribution.QUERIES, *six_numbers.QUERIES, *instrument.QUERIES]
