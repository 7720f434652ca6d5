"""Preparation of outlines: repair, simplification, choice of levels."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_METRES_A_DEGREE = 111_195.0


def repaired_ring(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Closed, without points that repeat the one before; empty if fewer than three different points are left."""
    out: list[tuple[float, float]] = []
    for p in points:
        if not out or p != out[-1]:
            out.append(p)
    if len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return [*out, out[0]] if len(set(out)) > 2 else []


def simplified_ring(points: list[tuple[float, float]], metres: float) -> list[tuple[float, float]]:
    """A repaired ring without the points that lie nearer than `metres` to the line that stays (Douglas and Peucker), from
    its first point and the one farthest from it; a ring that would collapse keeps its shape."""
    ring = repaired_ring(points)
    if len(ring) < 5:
        return ring
    at = np.array(ring, float)
    scale = np.array([_METRES_A_DEGREE * math.cos(math.radians(at[:, 1].mean())), _METRES_A_DEGREE])
    flat = at * scale
    keep = np.zeros(len(at), bool)
    far = int(((flat - flat[0]) ** 2).sum(axis=1).argmax())
    keep[[0, far, len(at) - 1]] = True
    todo = [(0, far), (far, len(at) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, d = flat[i], flat[j] - flat[i]
        inner = flat[i + 1 : j] - a
        t = np.clip(inner @ d / max(float(d @ d), 1e-12), 0, 1)
        apart = np.sqrt(((inner - t[:, None] * d) ** 2).sum(axis=1))
        k = int(apart.argmax())
        if apart[k] > metres:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return [ring[i] for i in np.flatnonzero(keep)] if keep.sum() > 3 else ring


def simplified(regions: DataFrame, metres: float, rings: str = "rings") -> DataFrame:
    """The regions with repaired and simplified rings; rings that enclose nothing go, null rings stay null. metres = 0 repairs only."""
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    names = regions.columns
    at = names.index(rings)

    def run(batches):
        for batch in batches:
            made = []
            for own in batch.column(at).to_pylist():
                if own is None:
                    made.append(None)
                    continue
                plain = [[(p["x"], p["y"]) for p in r or () if p and p["x"] is not None and p["y"] is not None] for r in own]
                new = [simplified_ring(r, metres) if metres > 0 else repaired_ring(r) for r in plain]
                made.append([[{"x": x, "y": y} for x, y in r] for r in new if r])
            yield pa.RecordBatch.from_arrays([pa.array(made, kind) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    fields = ", ".join(f"`{f.name}` {'array<array<struct<x:double,y:double>>>' if f.name == rings else f.dataType.simpleString()}" for f in regions.schema)
    return regions.mapInArrow(run, fields)


def prepared(regions: DataFrame, country: str | None = None, levels: tuple[int, ...] = (1, 2, 3), metres: float = 250.0) -> DataFrame:
    """Regions of some levels, of the ids that begin with a country's code, simplified. An empty level is an error, since
    every later step needs all of them."""
    out = regions.where(F.col("level").isin(*levels))
    if country:
        out = out.where(F.col("nuts_id").startswith(country))
    found = {r["level"] for r in out.select("level").distinct().collect()}
    if missing := set(levels) - found:
        raise ValueError(f"no regions of level {sorted(missing)}")
    return simplified(out, metres)
