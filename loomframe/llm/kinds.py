"""Kinds of text: clusters of style, fitted to all rows.

A text's style is a few shares of its characters and words that don't depend on its language: blanks, line ends, digits, capitals,
marks, symbols, words a character, words a line and length. Styles are standardised by the mean and deviation of all rows and
clustered by Lloyd's steps, each an aggregate over all rows; the first centres lie along the styles' axes, so a fit repeated gives the same kinds.
What reaches the driver is KINDS centres a step.

Defined results: null and blank texts have the style of nothing (zeros); ties of distance go to the lower kind; repeated rows are of one kind.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import ship

ship(__name__)

KINDS = 6
STEPS = 8
_CLASSES = {
    "blank": b" \t\x0b\x0c\r",
    "line": b"\n",
    "digit": b"0123456789",
    "capital": bytes(range(65, 91)),
    "mark": b".,;:!?'\"()-",
    "symbol": b"#*$%&|<>@/\\=+_{}[]~^`",
}
TABLE = np.zeros(256, np.int64)
for _i, _bytes in enumerate(_CLASSES.values()):
    TABLE[list(_bytes)] = _i + 1
#: Values of a style.
DIMENSIONS = len(_CLASSES) + 2


def style(texts: list) -> np.ndarray:
    """The styles of texts (bytes or None), a row each."""
    out = np.zeros((len(texts), DIMENSIONS))
    k = len(_CLASSES)
    for row, t in zip(out, texts):
        if not t:
            continue
        counts = np.bincount(TABLE[np.frombuffer(t, np.uint8)], minlength=k + 1)[1:]
        row[:k] = np.sqrt(counts / len(t))
        blanks, lines = counts[0] + counts[1], counts[1]
        row[k] = np.log1p((blanks + 1) / (lines + 1))
        row[k + 1] = np.log1p(len(t)) / 4
    return out


def nearest(column: str, model: tuple[list, list, list]) -> Column:
    """The kind of a style: the number of its nearest centre, as text.

    The squared distance to a centre is linear in the style but for a part that all centres share, so each takes DIMENSIONS products and is computed once.
    """
    mean, scale, centres = model
    apart = []
    for k, centre in enumerate(centres):
        slope = [-2.0 * s * c for s, c in zip(scale, centre)]
        base = sum(c * c - g * m for c, g, m in zip(centre, slope, mean))
        apart.append(F.struct(sum((F.get(F.col(column), i) * g for i, g in enumerate(slope) if g), F.lit(base)).alias("d"), F.lit(k).alias("k")))
    return F.array_min(F.array(*apart))["k"].cast("string")


def fitted(rows: DataFrame, column: str, n: int = KINDS, steps: int = STEPS) -> tuple[list, list, list]:
    """(means, 1 / deviations, centres) of the styles in a column of arrays."""
    values = [F.get(F.col(column), i) for i in range(DIMENSIONS)]
    got = rows.agg(*[F.avg(v) for v in values], *[F.stddev_pop(v) for v in values]).first()
    mean = [round(float(v or 0), 9) for v in got[:DIMENSIONS]]
    scale = [round(1 / v, 9) if v and v > 1e-9 else 0.0 for v in got[DIMENSIONS:]]
    centres = [[0.0] * DIMENSIONS] + [[2.0 * (j == i) for j in range(DIMENSIONS)] for i in range(1, n)]
    for _ in range(steps):
        model = (mean, scale, centres)
        at = rows.select(nearest(column, model).alias("kind"), column).groupBy("kind").agg(*[F.avg(v) for v in values]).collect()
        new = list(centres)
        for r in at:
            new[int(r[0])] = [round((float(v) - m) * s, 6) for v, m, s in zip(r[1:], mean, scale)]
        if new == centres:
            break
        centres = new
    return mean, scale, centres
