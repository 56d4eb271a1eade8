"""All registered queries."""

from faultline.plans import catalog_events, catalog_models, catalog_series, catalog_streams, catalog_tables, catalog_temporal, catalog_text  # noqa: F401
from faultline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
