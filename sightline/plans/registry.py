"""Every query of the reports, with the SQL it is checked against."""

from __future__ import annotations

from sightline.operators import retrieval
from sightline.plans import analytics, changes, console, ledger, operations, parameters, telemetry, windows
from sightline.plans.report import callables
from sightline.streaming import liveness, retries

_REPORTS = analytics.REPORTS | operations.REPORTS
_STREAMED = {"retry_queue": retries.retry_queue, "worker_changes": liveness.worker_changes}
_MODULES = (retrieval, parameters, ledger, changes, windows, telemetry, console)
QUERIES: dict = callables(_REPORTS) | _STREAMED
ORACLES: dict[str, str] = {name: r.oracle() for name, r in _REPORTS.items()} | {"retry_queue": retries.RETRY_SQL, "worker_changes": liveness.CHANGES_SQL}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
