"""Import every query module so the registry is complete."""

from leadlens.plans import lead_queries, model_queries, text_queries, upload_queries  # noqa: F401
from leadlens.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
