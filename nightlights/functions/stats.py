"""Significance of test statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scholz and Stephens (1987), k-sample Anderson-Darling tests, table 2. A level's critical value with
#: m + 1 groups is b0 + b1 / sqrt(m) + b2 / m.
LEVELS = (0.25, 0.1, 0.05, 0.025, 0.01, 0.005, 0.001)
B0 = (0.675, 1.281, 1.645, 1.96, 2.326, 2.573, 3.085)
B1 = (-0.245, 0.25, 0.678, 1.149, 1.822, 2.364, 3.615)
B2 = (-0.105, -0.305, -0.362, -0.391, -0.396, -0.345, -0.154)


def level_curve(k: int) -> np.ndarray:
    """Coefficients, highest power first, of the parabola that gives a level's logarithm from the normalised statistic of k groups."""
    m = k - 1
    return np.polyfit([a + b / math.sqrt(m) + c / m for a, b, c in zip(B0, B1, B2, strict=True)], np.log(LEVELS), 2)


def anderson_normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (a2, n, k, H) with statistic, a2 less its mean over its deviation where all groups have one distribution, and p,
    interpolated between the levels 0.001 and 0.25 and held to them. Null where n < 4 or k < 2."""
    for rows in batches:
        out = []
        for n, k, h_groups, a2 in zip(rows["n"].tolist(), rows["k"].tolist(), rows["H"].tolist(), rows["a2"].tolist(), strict=True):
            if n < 4 or k < 2 or a2 is None or a2 != a2:
                out.append((None, None))
                continue
            i = np.arange(1, n)
            h = (1 / i).sum()
            g = ((np.cumsum(1 / (n - i)) - 1 / (n - i)) / i).sum()
            a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * h_groups
            b = (2 * g - 4) * k**2 + 8 * h * k + (2 * g - 14 * h - 4) * h_groups - 8 * h + 4 * g - 6
            c = (6 * h + 2 * g - 2) * k**2 + (4 * h - 4 * g + 6) * k + (2 * h - 6) * h_groups + 4 * h
            d = (2 * h + 6) * k**2 - 4 * h * k
            t = (a2 - (k - 1)) / math.sqrt((a * n**3 + b * n**2 + c * n + d) / ((n - 1) * (n - 2) * (n - 3)))
            out.append((t, min(0.25, max(0.001, math.exp(np.polyval(level_curve(k), t))))))
        yield rows.assign(statistic=pd.array([x for x, _ in out], "Float64"), p=pd.array([x for _, x in out], "Float64"))


def student_p(t: Column, dof: Column) -> Column:
    """Two-sided p of a t statistic with a whole number of degrees of freedom, by the finite series in cosines; null below one."""
    theta = F.atan(F.abs(t) / F.sqrt(dof))
    cos2, odd = F.cos(theta) ** 2, F.pmod(dof, F.lit(2)) == 1
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))
    # terms cos^(2j) times 1/2 * 3/4 * ... for even, 2/3 * 4/5 * ... for odd degrees
    factor = lambda j: F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
    count = F.when(odd, (dof - 1) / 2).otherwise(dof / 2).cast("int")
    series = F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), zero, lambda s, j: F.struct((s["sum"] + F.when(j <= count, s["term"]).otherwise(0.0)).alias("sum"), (s["term"] * factor(j) * cos2).alias("term")))["sum"]
    inside = F.when(odd, (theta + F.sin(theta) * F.cos(theta) * series) * 2 / math.pi).otherwise(F.sin(theta) * series)
    return F.when(dof >= 1, 1 - inside)
