"""A bound on frequencies, so that what is sent to every task has a proven size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F


def frequent_from(counts: DataFrame, n: str, most: int) -> int:
    """A frequency that at most ``most`` rows of ``counts`` reach in the column ``n``.

    Rows are counted per power of 2**(1/8) of their frequency, so at most 8 * 63 rows come to the driver.
    """
    step = F.floor(F.log2(n) * 8).cast("int")
    steps = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    total, least = 0, None
    for row in steps:
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    return 1 << 62 if least is None else math.ceil(2 ** (least / 8) - 1e-9)
