"""Registered queries. Importing this package fills the registry."""

from lattica.catalog import factors as _factors  # noqa: F401
from lattica.catalog import models as _models  # noqa: F401
from lattica.catalog import panels as _panels  # noqa: F401
from lattica.catalog import portfolios as _portfolios  # noqa: F401
from lattica.catalog import research as _research  # noqa: F401
from lattica.catalog import rules as _rules  # noqa: F401
from lattica.catalog import storage as _storage  # noqa: F401
from lattica.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
