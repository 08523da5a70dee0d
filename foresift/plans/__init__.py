"""All registered queries and their SQL."""

from foresift.plans import backtests, boards, distributions, hierarchies, monitoring, preparation, scans, searches, wrappers  # noqa: F401
from foresift.plans.common import QUERIES, SQL  # noqa: F401
