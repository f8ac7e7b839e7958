"""Named queries over the tables, with their SQL."""

from . import composition, datasets, detection, evaluation, selections
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "composition", "datasets", "detection", "evaluation", "selections"]
