"""All registered queries; importing this module fills the registry."""

from cohortlens.plans import catalog_fair_drift, catalog_metrics, catalog_ml, catalog_profile  # noqa: F401
from cohortlens.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
