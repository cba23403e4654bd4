"""The cut of a statistic that separates labelled rows with the fewest errors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096


def cut(labelled: DataFrame, reach: float) -> float:
    """The value of x from which on y = 1 has the fewest errors over all rows (x double, y 0 or 1).

    x is clipped to -reach .. reach and counted in BINS bins, so that no more than that comes to the driver.
    Of several best values the middle of the first and last is taken; without rows, 0.
    """
    place = F.floor((F.greatest(F.least("x", F.lit(reach)), F.lit(-reach)) + reach) * (BINS / 2 / reach)).cast("int")
    n = np.zeros((2, BINS + 1))
    for r in labelled.groupBy(F.least(place, F.lit(BINS - 1)).alias("at"), F.col("y").cast("int").alias("y")).count().collect():
        n[r["y"], r["at"]] = r["count"]
    if not n.any():
        return 0.0
    wrong = np.concatenate([[0], np.cumsum(n[1])]) + n[0].sum() - np.concatenate([[0], np.cumsum(n[0])])
    best = np.flatnonzero(wrong == wrong.min())
    return float(-reach + (best[0] + best[-1]) / 2 * (2 * reach / BINS))
