"""All registered queries of the catalogue jobs."""

from . import addresses, files, funnels, imports, platform, registers, selection, serving  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "f1_registry_funnel"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
