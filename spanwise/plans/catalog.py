"""Every registered query and its oracle."""

from spanwise.plans import (  # noqa: F401
    catalog_audit,
    catalog_correlation,
    catalog_drift,
    catalog_requests,
    catalog_sources,
    catalog_streaming,
)
from spanwise.plans.registry import ORACLES, QUERIES  # noqa: F401
