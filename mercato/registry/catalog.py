"""All registered queries."""

from mercato.registry import parts  # noqa: F401  (first: the others use its parts)
from mercato.registry import marts  # noqa: F401
from mercato.registry import business, columns  # noqa: F401
from mercato.registry import texts  # noqa: F401
from mercato.registry import models, stores  # noqa: F401
from mercato.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
