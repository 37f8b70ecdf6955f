"""All registered queries."""

from corrobora.plans import (  # noqa: F401
    decision_queries, document_queries, evidence_queries, linkage_queries, views,
)
from corrobora.plans.registry import ORACLES, QUERIES  # noqa: F401
