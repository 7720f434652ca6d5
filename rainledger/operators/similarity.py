"""Duplicates by title and text of an article archive: exact pairs, greedy keeping, title clusters, medoids."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rainledger.functions.text import first_line, jaccard, shingles, squash, words
from rainledger.storage import Workspace


def shingle_sets(texts: DataFrame, k: int = 5, text: str = "text") -> DataFrame:
    """(id, s, n): distinct hashed word shingles, empty texts left out."""
    s = F.transform(shingles(words(squash(F.col(text))), k), lambda x: F.xxhash64(x))
    return texts.select("id", F.array_sort(s).alias("s")).withColumn("n", F.size("s")).where("n > 0")


def _prefix(tokens: DataFrame, at_least: float, *more: str) -> DataFrame:
    """(id, n, *more, t): of the elements t of sets of n elements the first n - ceil(at_least n) + 1 by rarity; two sets of that
    similarity share one of them. Elements of one set only are the rarest: they come first and need no row."""
    rarity = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    unique = F.col("n") - F.count("*").over(W.partitionBy("id"))
    place = F.row_number().over(W.partitionBy("id").orderBy("df", "t")) + unique
    return tokens.join(rarity, "t").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(at_least) - 1e-9) + 1).select("id", "n", *more, "t")


def similar_pairs(texts: DataFrame, at_least: float = 0.88, k: int = 5, text: str = "text") -> DataFrame:
    """(a, b, sim), a < b: all pairs of at least that Jaccard similarity, exactly.

    Equal sets are collapsed first: a set's copies are linked to its smallest id only, with similarity 1. Distinct sets
    meet by prefix filtering: shingles are ordered by rarity, and two sets of similarity t share one of the first
    n - ceil(t n) + 1 rarest of each; sizes must also agree within t.
    """
    ws = Workspace(texts.sparkSession, "similar")
    sets = ws.write("sets", shingle_sets(texts, k, text))
    key = F.xxhash64("s")
    groups = sets.groupBy(key.alias("h"), "n").agg(F.min("id").alias("rep"))
    member = sets.withColumn("h", key).select("id", "h", "n").join(groups, ["h", "n"])
    copies = member.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    reps = ws.write("reps", sets.join(groups.select(F.col("rep").alias("id")), "id", "left_semi"))
    prefix = _prefix(reps.select("id", "n", F.explode("s").alias("t")), at_least)
    a, b = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "t"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "t")
    met = a.join(b, "t").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= at_least * F.greatest("na", "nb"))).select("a", "b").distinct()
    sa, sb = reps.select(F.col("id").alias("a"), F.col("s").alias("sa")), reps.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    near = met.join(sa, "a").join(sb, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("sim")).where(F.col("sim") >= at_least)
    return near.unionAll(copies)


def keep_greedily(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, kept_id, sim): visiting ids upwards, an id is dropped for its most similar kept neighbour before it (the
    smaller id if equal); kept ones have a null kept_id. Decided in rounds, as many as the longest alternating chain."""
    ws = Workspace(ids.sparkSession, "greedy")
    pairs = ws.write("pairs", pairs.where("a < b"))
    state = ws.write("state_0", ids.select("id").distinct().withColumn("kept", F.lit(None).cast("boolean")))
    for turn in count(1):  # the smallest undecided id is decided in any round
        earlier = pairs.join(state.select(F.col("id").alias("a"), F.col("kept").alias("ka")), "a").groupBy(F.col("b").alias("id")).agg(F.max(F.coalesce("ka", F.lit(False))).alias("hit"), F.max(F.col("ka").isNull()).alias("wait"))
        judged = state.join(earlier, "id", "left").select("id", F.coalesce("kept", F.when(F.col("hit"), False).when(~F.coalesce("wait", F.lit(False)), True)).alias("kept"))
        state = ws.write(f"state_{turn}", judged)
        if not state.where("kept is null").limit(1).count():
            break
    kept = state.where("kept").select(F.col("id").alias("a"))
    best = pairs.join(kept, "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min(F.struct((-F.col("sim")).alias("s"), "a")).alias("m"))
    lost = state.where("not kept").join(best, "id").select("id", F.col("m.a").alias("kept_id"), (-F.col("m.s")).alias("sim"))
    return lost.unionByName(state.where("kept").select("id", F.lit(None).cast(ids.schema["id"].dataType).alias("kept_id"), F.lit(None).cast("double").alias("sim")))


def removal_report(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, kept_id, sim, reason): what greedy keeping drops, and the texts without a shingle, which have no kept id."""
    lost = keep_greedily(pairs, texts.select("id")).where("kept_id is not null").select("id", "kept_id", "sim", F.lit("near_duplicate").alias("reason"))
    empty = texts.where(F.size(words(squash(F.coalesce(F.col("text"), F.lit(""))))) == 0).select("id").distinct()
    kind = texts.schema["id"].dataType
    return lost.unionByName(empty.select("id", F.lit(None).cast(kind).alias("kept_id"), F.lit(None).cast("double").alias("sim"), F.lit("empty_text").alias("reason")))


def title_pairs(articles: DataFrame, at_least: float = 0.85, text: str = "text") -> DataFrame:
    """(a, b): titles that begin with the same word and whose 3-word shingles agree. Distinct titles only; a title's
    number is the smallest id that carries it. Titles meet in the rarest of their shingles (prefix filter), so a
    frequent beginning pairs nothing by itself."""
    titles = articles.select("id", squash(first_line(F.col(text))).alias("title")).where("title <> ''").groupBy("title").agg(F.min("id").alias("id"))
    t = titles.select("id", F.split("title", " ")[0].alias("word"), shingles(F.split("title", " "), 3).alias("s")).withColumn("n", F.size("s"))
    t = Workspace(articles.sparkSession, "title-sets").write("sets", t)
    rows = _prefix(t.select("id", "n", "word", F.explode("s").alias("t")), at_least, "word")
    a, b = (rows.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), "word", "t") for x in "ab")
    met = a.join(b, ["word", "t"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= at_least * F.greatest("na", "nb"))).select("a", "b").distinct()
    both = met.join(t.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(t.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return both.where(jaccard(F.col("sa"), F.col("sb"), 1.0) >= at_least).select("a", "b")


def medoid_duplicates(members: DataFrame, at_least: float = 0.44, shortest: int = 200) -> DataFrame:
    """(cluster, id, medoid): members dropped for a medoid, cluster by cluster.

    members: (cluster, id, text). The medoid is the member of the highest mean similarity to those left (ties: the
    smaller id); those at least that similar to it go; again with the rest until nothing changes. Texts below
    `shortest` letters are similar to nothing. Clusters are those of near-equal titles.

    Members of equal shingle sets are one row with a weight. Rows meet in shared shingles, and each round is a
    few aggregates over the pairs for all clusters at once, so no task holds a cluster; rounds are as many as one cluster
    has medoids.
    """
    ws = Workspace(members.sparkSession, "medoids")
    tokens = shingles(F.split(F.trim(F.regexp_replace(F.lower("text"), r"(?U)\s+", " ")), " "), 3)
    s = F.when(F.char_length("text") >= shortest, F.array_sort(F.transform(tokens, lambda x: F.xxhash64(x))))
    rows = ws.write("rows", members.select("cluster", "id", F.coalesce(s, F.array().cast("array<bigint>")).alias("s")).distinct())
    # a short text is alone; copies share the number of their first member
    sets = ws.write("sets", rows.groupBy("cluster", "s", F.when(F.size("s") == 0, F.col("id")).alias("alone")).agg(F.min("id").alias("c"), F.count("*").alias("m")))
    copies = rows.where(F.size("s") > 0).join(sets.where("m > 1").select("cluster", "s", "c"), ["cluster", "s"]).where("id <> c").select("cluster", "id", "c")
    copies = ws.write("copies", copies)
    each = sets.where(F.size("s") > 0).select("cluster", "c", F.size("s").alias("n"), F.explode("s").alias("t"))
    met = each.alias("a").join(each.alias("b"), ["cluster", "t"]).where("a.c < b.c").groupBy("cluster", F.col("a.c").alias("i"), F.col("b.c").alias("j"), F.col("a.n").alias("ni"), F.col("b.n").alias("nj")).agg(F.count("*").alias("k"))
    sims = met.select("cluster", "i", "j", (F.col("k") / (F.col("ni") + F.col("nj") - F.col("k"))).alias("sim"))
    sims = ws.write("sims", sims.unionAll(sims.select("cluster", F.col("j").alias("i"), F.col("i").alias("j"), "sim")))
    left = ws.write("left_0", sets.select("cluster", "c", "m", (F.size("s") > 0).alias("long"), F.lit(False).alias("used"), F.lit(True).alias("active")))
    out = ws.write("out_0", members.sparkSession.createDataFrame([], "cluster long, c long, medoid long, all boolean"))
    for turn in count(1):
        live = left.where("active")
        weights = sims.join(live.select("cluster", F.col("c").alias("j"), F.col("m").alias("mj")), ["cluster", "j"]).groupBy("cluster", F.col("i").alias("c")).agg(F.sum(F.col("sim") * F.col("mj")).alias("others"))
        size = live.groupBy("cluster").agg(F.sum("m").alias("size"))
        total = F.coalesce("others", F.lit(0.0)) + F.when(F.col("long"), F.col("m") - 1).otherwise(0)
        means = live.join(weights, ["cluster", "c"], "left").join(size, "cluster").where("size > 1 and not used").withColumn("mean", F.round(total / (F.col("size") - 1), 12))
        best = ws.write(f"best_{turn}", means.groupBy("cluster").agg(F.min(F.struct((-F.col("mean")).alias("s"), "c", F.when(F.col("long"), F.col("m")).otherwise(F.lit(1)).alias("m"))).alias("b")).select("cluster", F.col("b.c").alias("medoid"), F.col("b.m").alias("m")))
        near = sims.where(F.col("sim") >= at_least).join(best.select("cluster", F.col("medoid").alias("i")), ["cluster", "i"]).select("cluster", F.col("j").alias("c"), F.col("i").alias("medoid")).join(live.select("cluster", "c"), ["cluster", "c"], "left_semi")
        gone = near.select("cluster", "c", "medoid", F.lit(True).alias("all")).unionAll(best.where("m > 1").select("cluster", F.col("medoid").alias("c"), "medoid", F.lit(False)))
        gone = ws.write(f"out_{turn}", gone)
        if gone.isEmpty():
            break
        out = out.unionAll(gone)
        after = live.join(gone.where("all").select("cluster", "c"), ["cluster", "c"], "left_anti").join(best.select("cluster", F.col("medoid").alias("c"), F.lit(1).alias("now")), ["cluster", "c"], "left")
        after = after.join(gone.select("cluster").distinct(), "cluster", "left_semi")
        left = ws.write(f"left_{turn}", after.select("cluster", "c", F.when(F.col("now") == 1, F.lit(1)).otherwise(F.col("m")).cast("bigint").alias("m"), "long", (F.col("used") | F.col("now").isNotNull()).alias("used"), "active"))
        ws.drop(f"left_{turn - 1}")
    firsts = out.where("all").select("cluster", F.col("c").alias("id"), "medoid")
    rest = copies.join(out.select("cluster", "c", "medoid"), ["cluster", "c"]).select("cluster", "id", "medoid")
    return firsts.unionAll(rest)
