"""Connected components of a link table."""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainledger.storage import Workspace


#: Distinct edges up to which one task joins them by union-find; larger graphs are contracted in rounds.
ONE_TASK_EDGES = 200_000


def _union_find(batches):
    root: dict[int, int] = {}

    def find(x):
        top = x
        while (above := root.setdefault(top, top)) != top:
            top = above
        while x != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    ids = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(i) for i in ids], pa.int64())], names=["id", "root"])


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(id, root) of every node of the edges (a, b): root is the smallest id it is linked to by way of any others.

    Few edges (counted first) are joined by union-find in one task. Others go through alternating
    large-star and small-star contraction (Kiveris et al., 2014): a few rounds of aggregates and joins,
    each written to the shared folder, until one changes nothing; no neighbourhood is collected.
    """
    now = ws.write("edges_0", edges.select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")).where("a <> b").distinct())
    if now.count() <= ONE_TASK_EDGES:
        return now.repartition(1).mapInArrow(_union_find, "id bigint, root bigint")
    mark = None
    for turn in count(1):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        after = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = ws.write(f"edges_{turn}", after)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        ws.drop(f"edges_{turn - 1}")
        now = after
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
