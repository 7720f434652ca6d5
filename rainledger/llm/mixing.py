"""Sources combined to target shares of a wanted size, by Sainte-Lague apportionment of token blocks."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rainledger.llm.encoding import token_counts
from rainledger.llm.pairs import small
from rainledger.storage import Workspace

#: Tokens of a block of documents at most, and blocks that the smallest mix is cut into at least.
BLOCK_TOKENS, LEAST_BLOCKS = 1_024, 1_000
#: Documents of a source that one shard holds about.
SHARD_ROWS = 20_000


def sainte_lague(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats for each party by the highest quotients weight / (2 seats + 1), none beyond its cap.

    Ties go to the earlier party. Seats that no party can take are left. All seats whose quotient lies above a bound
    found by halving are given at once, so the work does not grow with the seats.
    """
    w, cap = np.asarray(weights, float), np.asarray(caps, np.int64)
    w = np.where(cap > 0, w, 0.0)
    if not len(w) or w.max() <= 0 or seats <= 0:
        return [0] * len(w)

    def above(quotient: float) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.where(w > 0, np.minimum(cap, np.maximum(0, np.ceil(np.minimum((w / quotient + 1) / 2, 2.0**62)) - 1)), 0).astype(np.int64)

    low, high = 0.0, float(w.max()) * 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high) or middle == 0.0:
            break
        low, high = (middle, high) if above(middle).sum() > seats else (low, middle)
    got = above(high).tolist()
    queue = [(-x / (2 * g + 1), i) for i, (x, g, c) in enumerate(zip(w.tolist(), got, caps)) if x > 0 and c > g]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(queue, (-w[i] / (2 * got[i] + 1), i))
    return got


def _source_quotas(block: float):
    """For the targets of one mix: how many tokens of each source, in whole passes over it and a rest."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("source").reset_index(drop=True)
        most = own["have"] * own["max_repeats"].clip(lower=0)
        seats = sainte_lague(own["target_share"].clip(lower=0).tolist(), np.ceil(most / block).astype("int64").tolist(), round(own["wanted"].max() / block))
        quota = np.minimum(most, np.round(np.array(seats) * block)).astype("int64")
        have = own["have"].clip(lower=1)
        return own.assign(wanted_tokens=own["wanted"].max().round().astype("int64"), passes=quota // have, rest=quota % have)[["mix_id", "source", "given_share", "wanted_tokens", "passes", "rest"]]

    return run


def _shard_quotas(block: float):
    """For the shards of one source of a mix: how many tokens of its rest each gives."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("shard").reset_index(drop=True)
        seats = sainte_lague(own["tokens"].tolist(), np.ceil(own["tokens"] / block).astype("int64").tolist(), round(own["rest"].iloc[0] / block))
        return own.assign(part=np.round(np.array(seats) * block).astype("int64"))[["mix_id", "source", "shard", "passes", "part"]]

    return run


def mix_documents(texts: DataFrame, targets: DataFrame, seed: int = 1, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of every mix.

    texts: (id, source, text); targets: (mix_id, source, target_share, max_repeats, total_tokens_share). Sizes are
    tokens of the public tokenizer; a mix wants total_tokens_share of all tokens of texts. selection has
    (mix_id, id, source, tokens, repeats) for every document that is used, repeats at most max_repeats; report has
    (mix_id, source, target_share, actual_share, wanted_tokens, tokens, documents, most_repeats) for every target.

    Documents of a source lie in seeded random order, cut into shards by a hash and within a shard into blocks of
    equal tokens. The blocks of a mix's wanted size go to its sources by Sainte-Lague; a source that has no more to
    give at its cap leaves its blocks to the others, which the shares then show. Whole passes over a source come
    first; the rest of its quota is apportioned to its shards, again by Sainte-Lague, and each shard gives blocks in
    a seeded order of its own for every mix. A source so reaches its quota to about a block. No sort holds
    more than a shard and nothing but the sum of all tokens comes to the driver.

    A source without documents, a null share and a null cap give nothing; null sources are in no mix but count in the
    total; empty and null texts have no tokens and are not used. Repeated ids are documents of their own; repeated
    targets count once with their largest values.
    """
    spark = texts.sparkSession
    ws = Workspace(spark, "mixing")
    sized = token_counts(texts.select("id", "source", "text"), ["id", "source"])
    sized = ws.write("sized", sized.where("tokens > 0"))
    most = F.max
    goals = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(most("target_share").alias("given_share"), most("max_repeats").alias("max_repeats"), most("total_tokens_share").alias("total_share"))
    goals = ws.write("goals", goals)
    names = small(ws.write("names", goals.select("source").distinct()))
    per_source = ws.write("sources", sized.join(names, "source").groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("n")))
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    least = goals.groupBy("mix_id").agg(most("total_share").alias("s")).where("s > 0").agg(F.min("s")).first()[0] or 0.0
    block = float(min(block_tokens, max(1.0, least * total / LEAST_BLOCKS)))

    zero = F.lit(0)
    asked = goals.join(small(per_source), "source", "left").select("mix_id", "source", "given_share", F.coalesce("given_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", zero).cast("bigint").alias("max_repeats"), (F.coalesce("total_share", F.lit(0.0)) * total).alias("wanted"), F.coalesce("have", zero).cast("bigint").alias("have"))
    quotas = asked.groupBy("mix_id").applyInPandas(_source_quotas(block), "mix_id int, source string, given_share double, wanted_tokens bigint, passes bigint, rest bigint")
    quotas = ws.write("quotas", quotas)

    shards = small(ws.write("shards", per_source.select("source", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("shards"))))
    spot = F.xxhash64(F.lit(seed), "id")
    placed = sized.join(shards, "source").select("source", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.col("shards")).cast("int").alias("shard"), spot.alias("spot"), "id", "tokens")
    before = F.coalesce(F.sum("tokens").over(W.partitionBy("source", "shard").orderBy("spot", "id").rowsBetween(W.unboundedPreceding, -1)), zero)
    # a document belongs to the block that holds its middle
    blocks = ws.write("blocks", placed.select("source", "shard", F.floor((before + F.col("tokens") / 2) / block).alias("block"), "id", "tokens"))
    sizes = ws.write("sizes", blocks.groupBy("source", "shard", "block").agg(F.sum("tokens").alias("tokens")))
    shard_sizes = sizes.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens"))
    parts = quotas.where("rest > 0").join(shard_sizes, "source").groupBy("mix_id", "source").applyInPandas(_shard_quotas(block), "mix_id int, source string, shard int, passes bigint, part bigint")
    parts = small(ws.write("parts", parts.where("part > 0")))
    own = sizes.join(parts, ["source", "shard"])
    turn = W.partitionBy("mix_id", "source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "mix_id", "block"), "block").rowsBetween(W.unboundedPreceding, -1)
    taken = own.withColumn("given", F.coalesce(F.sum("tokens").over(turn), zero)).where(F.col("given") + F.col("tokens") / 2 < F.col("part"))
    taken = small(ws.write("taken", taken.select("mix_id", "source", "shard", "block", "passes")))
    # sources that are used whole: every document, once more if its block is taken
    whole = blocks.join(small(ws.write("whole", quotas.where("passes > 0").select("mix_id", "source", "passes"))), "source")
    whole = whole.join(taken.select("mix_id", "source", "shard", "block", F.lit(1).alias("more")), ["mix_id", "source", "shard", "block"], "left")
    part = blocks.join(taken.where("passes = 0"), ["source", "shard", "block"])
    columns = lambda repeats: ["mix_id", "id", "source", "tokens", repeats.cast("int").alias("repeats")]
    selection = ws.write("selection", whole.select(*columns(F.col("passes") + F.coalesce("more", zero))).unionAll(part.select(*columns(F.lit(1)))))
    reached = selection.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    sums = reached.groupBy("mix_id").agg(F.sum("tokens").alias("all_tokens"))
    report = quotas.join(reached, ["mix_id", "source"], "left").join(sums, "mix_id", "left")
    report = report.select("mix_id", "source", F.col("given_share").alias("target_share"), F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"), "wanted_tokens", F.coalesce("tokens", zero).alias("tokens"), F.coalesce("documents", zero).alias("documents"), F.coalesce("most_repeats", zero).alias("most_repeats"))
    return selection, report
