"""Groups of texts with small edits: DartMinHash signatures, banded join, exact check, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainledger.llm.pairs import bucket_pairs, first_of_copies, small
from rainledger.llm.shingles import sketch, verify
from rainledger.operators.graph import components
from rainledger.storage import Workspace

#: 200 coordinates, bands of 5, two shufflings: 80 bands, of which a pair must share two. A pair of
#: similarity 0.7 is missed with probability below 1e-5, one of 0.1 is kept with about 1e-7.
DARTS, ROWS, ROUNDS, LEAST_BANDS = 200, 5, 2, 2
#: Rows of a hot bucket that one task holds about.
BLOCK_ROWS = 1_024


def near_duplicate_groups(texts: DataFrame, k_words: int = 3, at_least: float = 0.7) -> DataFrame:
    """(group_id, id) of every id in a group of at least two; group_id is the smallest id of the group.

    texts: (id, text); other columns are ignored. Two ids belong together if the k-word similarity of
    their whole texts is at least `at_least`, also by way of others. Null ids and texts, and texts of
    fewer than 20 words, are in no group. An id that comes with several rows counts once; its rows
    are expected to hold the same text, and if they differ one of the texts represents it in the exact check.
    Equal shingle sets are collapsed before pairing, so any number of copies costs one set.
    """
    texts = texts.select(F.col("id").cast("bigint").alias("id"), "text").where("id is not null and text is not null")
    ws = Workspace(texts.sparkSession, "near-duplicates")
    sketches = ws.write("sketches", sketch(texts, k_words, DARTS, ROWS, ROUNDS))
    copies = ws.write("copies", first_of_copies(sketches))
    firsts = sketches.join(copies.select("print", F.col("rep").alias("id")), ["print", "id"], "left_semi")
    pairs, hot = bucket_pairs(ws, firsts, LEAST_BANDS)
    edges = ws.write("links", _check(ws.write("pairs", pairs.select("a", "b")), texts, k_words, at_least))
    if hot is not None:
        edges = edges.unionAll(_hot_links(ws, hot, firsts, texts, k_words, at_least))
    ws.drop("buckets", "pairs")
    roots = ws.write("roots", components(ws, edges))
    ids = sketches.select("id", "print").distinct().join(copies, "print").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    groups = ids.where("root is not null or copies > 1").select(F.coalesce("root", "rep").alias("group_id"), "id")
    return ws.write("groups", groups)


def _check(pairs: DataFrame, texts: DataFrame, k_words: int, at_least: float) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    return verify(pairs, texts.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), k_words, at_least)


def _hot_links(ws: Workspace, hot: DataFrame, firsts: DataFrame, texts: DataFrame, k_words: int, at_least: float) -> DataFrame:
    """Links within hot buckets, enough for the groups, without all pairs of a bucket.

    Every set is compared with the first of its bucket. Those linked to it are one group, whatever their number, and
    not compared with each other. A set that is not (an open one) is compared with the rest of the bucket as far as
    exact bounds allow a link: 1 - similarity is a metric, so the similarities of two sets to the first one may differ by
    1 - at_least at most; the sizes must agree; and a second key must be shared. The rows of a bucket are cut into blocks of
    about BLOCK_ROWS, which open sets meet one by one, so no task holds a bucket.
    """
    slack = 1 - at_least + 1e-9
    star = ws.write("star", hot.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    # a set less similar to the first one than this can't be linked to any set that is linked to it
    sims = ws.write("sims", _check(star, texts, k_words, 2 * at_least - 1))
    links = sims.where(F.col("sim") >= at_least)
    rows = hot.join(sims.select(F.col("a").alias("lead"), F.col("b").alias("id"), "sim"), ["lead", "id"], "left").join(firsts.select("id", "words"), "id")
    rows = ws.write("hot_rows", rows.select("key", "id", "words", F.when(F.col("id") == F.col("lead"), 1.0).otherwise(F.col("sim")).alias("sim")))
    linked = F.coalesce(F.col("sim") >= at_least, F.lit(False))
    if rows.where(~linked).isEmpty():
        return links
    blocks = small(ws.write("blocks", rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))))
    rows = rows.join(blocks, "key")
    every = rows.select("key", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.col("id").alias("y"), F.col("words").alias("n_y"), F.col("sim").alias("sim_y"), linked.alias("linked"))
    open_ = rows.where(~linked).select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("x"), F.col("words").alias("n_x"), F.col("sim").alias("sim_x"))
    near = F.when(F.col("linked"), F.col("sim_y") - F.col("sim_x") <= slack).otherwise((F.col("x") < F.col("y")) & F.coalesce(F.abs(F.col("sim_y") - F.col("sim_x")) <= slack, F.lit(True)))
    met = open_.join(every, ["key", "block"]).where(near & (F.least("n_x", "n_y") >= at_least * F.greatest("n_x", "n_y")))
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    keys = {x: firsts.select(F.col("id").alias(x), F.col("keys").alias(f"keys_{x}")) for x in "ab"}
    met = met.join(keys["a"], "a").join(keys["b"], "b").where(F.size(F.array_intersect("keys_a", "keys_b")) >= LEAST_BANDS).select("a", "b")
    return links.unionAll(ws.write("links_open", _check(ws.write("met", met), texts, k_words, at_least)))
