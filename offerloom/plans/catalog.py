"""All registered queries."""

from offerloom.plans import (  # noqa: F401
    catalog_chain,
    catalog_discovery,
    catalog_pages,
    catalog_rules,
    catalog_search,
    catalog_streams,
)
from offerloom.plans.registered import CATALOG

__all__ = ["CATALOG"]
