"""Table comparison on Spark: what was added, deleted or modified between two tables, by key."""

from .operators.diff import TableDiff
from .operators.model import Algorithm, DiffRun, DiffSummary, Status

__all__ = ["Algorithm", "DiffRun", "DiffSummary", "Status", "TableDiff"]
