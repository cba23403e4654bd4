"""Plan helpers: materialised lineage cuts, distributed ranks, the iterative loop."""

from orrery.plans.iterate import iterate, partitioned, salted, sent
from orrery.plans.materialize import materialize, release, sweep
from orrery.plans.ranking import ranked, running_sum

__all__ = ["iterate", "materialize", "partitioned", "ranked", "release", "running_sum", "salted", "sent", "sweep"]
