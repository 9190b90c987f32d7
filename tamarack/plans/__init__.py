"""The query catalogue: each entry has a Spark plan and, where SQL can express it, the SQL it must agree with."""

from tamarack.plans import dates, files, joins, nested, packages, pages, resolving, star, statistics, streams, texts  # noqa: F401
from tamarack.plans.registry import ORACLES, QUERIES  # noqa: F401
