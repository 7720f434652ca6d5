"""New batches against all accepted history, by persisted blocking keys and representative mappings.

A store is a folder. Each ingest adds one part (turn=N) to its tables and then a commit file, so a store can
be opened again by another session, and an ingest that died halfway is not seen:

* `keys` (key, id, words, zip): blocking keys of accepted texts, with the fields that pairs are scored on;
* `docs` (id, article, source_zip, text): accepted texts;
* `rejected` (id, article, match, sim, score) and `mapping` (id, representative): changed rows only;
* `commits/N`: parameters and pattern counts from which the field weights are learned.

An ingest sketches its own texts only; the history is never sketched or paired again. The batch's keys meet the stored
ones where these are scanned (beyond PROBE_KEYS keys both are shuffled), pairs that the learned weights do not rule out
get the exact check against the stored texts that were hit, and only clusters that the batch touched get new mapping rows.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rainledger.llm import pairs as buckets
from rainledger.llm.pairs import bands_of, bucket_pairs, first_of_copies, small
from rainledger.llm.shingles import sketch, verify
from rainledger.operators.graph import components
from rainledger.storage import Folder, Workspace

#: 120 coordinates, bands of 5, two shufflings: 48 blocking keys, of which a pair must share two.
#: A pair of similarity 0.8 is missed with probability below 1e-6.
DARTS, ROWS, ROUNDS, LEAST_BANDS = 120, 5, 2, 2
_BAND_STEPS, _RATIO_STEPS = (3, 5, 8, 12, 20, 32), (0.8, 0.85, 0.9, 0.97)
_LEVELS = (len(_BAND_STEPS) + 1, len(_RATIO_STEPS) + 1, 2)
#: Share of all matches that may lie, by the learned model, in patterns whose pairs are not checked.
LOSS = 1e-6
#: Keys of a batch up to which they are broadcast to the stored ones.
PROBE_KEYS = 150_000
#: Comparisons that a round may always spend on a hot bucket, in squares of the largest bucket that is not hot.
LEAD_SQUARES = 4
_SHIFT = 1 << 32
_LAST = 0x7FFFFFFF
_TABLES = {
    "keys": "key bigint, id bigint, words int, zip bigint",
    "docs": "id bigint, article bigint, source_zip string, text string",
    "rejected": "id bigint, article bigint, match bigint, sim double, score double",
    "mapping": "id bigint, representative bigint",
}


def learn_weights(patterns: dict[tuple[int, int, int], list[int]], loss: float = LOSS) -> tuple[dict[tuple[int, int, int], float], float]:
    """Fellegi-Sunter match weights (log2 m/u, summed over the fields) of all patterns, and the least weight to check.

    patterns: (levels of shared keys, size ratio and same archive) -> [pairs, pairs that the exact check confirmed].
    m and u of a level are its shares among confirmed and other pairs, smoothed by half a pair. The least weight is
    the highest one below which the model expects at most `loss` of all matches; without confirmed pairs everything
    is checked.
    """
    m, u = [], []
    for f, size in enumerate(_LEVELS):
        hit, miss = np.full(size, 0.5), np.full(size, 0.5)
        for levels, (n, links) in patterns.items():
            hit[levels[f]] += links
            miss[levels[f]] += n - links
        m.append(hit / hit.sum())
        u.append(miss / miss.sum())
    grid = np.indices(_LEVELS).reshape(3, -1).T
    weight = sum(np.log2(m[f][grid[:, f]] / u[f][grid[:, f]]) for f in range(3))
    weights = {tuple(int(x) for x in g): float(w) for g, w in zip(grid, weight)}
    if not any(links for _, links in patterns.values()):
        return weights, -np.inf
    order = np.argsort(weight)
    mass = np.cumsum(np.prod([m[f][grid[order, f]] for f in range(3)], axis=0))
    return weights, float(weight[order[min(np.searchsorted(mass, loss, side="right"), len(order) - 1)]])


class IncrementalDeduper:
    """Accepts or rejects texts batch by batch; `path` is a new folder or a store of an earlier session.

    `ingest(batch)` takes rows (id int, batch_no int, source_zip, text) of one archive or of several;
    the outcome is that of going through them by batch_no, then id: a text is rejected if its k-word
    similarity to some text accepted before is `at_least` or more. Null ids and texts are ignored, texts
    of fewer than 20 words are accepted and match nothing, a null batch_no comes after all others, an id
    that comes again, in this ingest or a later one, counts once with its smallest batch_no (its rows are
    expected to hold the same text). Batches must be ingested in the order of their numbers.

    Ids in the tables are batch_no * 2^32 + id, the order of the walk; `article` is the id itself.
    """

    def __init__(self, spark: SparkSession, path: str, k_words: int = 5, at_least: float = 0.8):
        self.spark, self.store = spark, Folder(spark, path)
        self.k_words, self.at_least = k_words, at_least
        self.patterns: dict[tuple[int, int, int], list[int]] = {}
        self.pool = ThreadPoolExecutor(3)  # for jobs that don't wait for each other
        done = [int(n) for n in self.store.names("commits") if n.isdigit()]
        self.turn = max(done, default=-1) + 1
        if done:
            state = json.loads(self.store.read_text(f"commits/{self.turn - 1}"))
            if (state["k_words"], state["at_least"]) != (k_words, at_least):
                raise ValueError(f"the store was made with {state['k_words']} words and {state['at_least']}")
            self.patterns = {tuple(p): [n, links] for p, n, links in state["patterns"]}

    def _all(self, name: str, with_turn: bool = False) -> DataFrame | None:
        """The committed rows of a table; None before the first ingest."""
        if not self.turn:
            return None
        rows = self.spark.read.schema(f"{_TABLES[name]}, turn int").option("basePath", self.store.path(name)).parquet(*[self.store.path(f"{name}/turn={t}") for t in range(self.turn)])
        return rows if with_turn else rows.drop("turn")

    def _add(self, name: str, rows: DataFrame) -> DataFrame:
        return self.store.write(f"{name}/turn={self.turn}", rows)

    def accepted(self) -> DataFrame:
        """(id, article, source_zip, text) of the accepted texts of at least 20 words, without copies."""
        return self._all("docs")

    def rejected(self) -> DataFrame:
        """(id, article, match, sim, score) of all rejected ids with the accepted one they are most similar to."""
        return self._all("rejected")

    def mapping(self) -> DataFrame:
        """(id, representative) of every clustered id: the newest row written for it."""
        return self._all("mapping", True).groupBy("id").agg(F.max_by("representative", "turn").alias("representative"))

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Rejected rows (id, article, match, sim, score) of the batch; the store then also holds its accepted texts."""
        at = Workspace(self.spark, f"ingest-{self.turn}")
        order = F.coalesce(F.col("batch_no"), F.lit(_LAST)).cast("bigint") * _SHIFT + F.col("id").cast("bigint")
        rows = batch.where("id is not null and text is not null").select(order.alias("id"), "source_zip", "text")
        rows = self._unseen(rows)
        sketches = at.write("sketches", self._one_row(sketch(rows, self.k_words, DARTS, ROWS, ROUNDS, ("source_zip",))))
        copies = first_of_copies(sketches)
        firsts = at.write("firsts", sketches.join(copies.withColumnRenamed("rep", "id"), ["print", "id"]).withColumn("zip", F.xxhash64("source_zip")))
        copies = firsts.select("print", F.col("id").alias("rep"), "copies")
        pairs, hot = bucket_pairs(at, firsts, LEAST_BANDS)
        scored = at.write("scored", self._candidates(pairs, firsts))
        texts = rows.select("id", "text")
        links = at.write("links", self._links(scored, texts))
        counted = self.pool.submit(self._count, scored, links)
        verdicts, every = self._decide(at, copies, sketches, links.drop("pattern"), hot, texts)
        out = self._add("rejected", self._matches(sketches, copies, verdicts, every))
        kept = firsts.join(out.select("id"), "id", "left_anti")
        one = rows.join(kept.select("id"), "id", "left_semi").groupBy("id").agg(F.min("source_zip").alias("source_zip"), F.min("text").alias("text"))
        parts = {
            "keys": bands_of(kept, "words", "zip").select("key", "id", "words", "zip"),
            "docs": one.select("id", (F.col("id") % _SHIFT).alias("article"), "source_zip", "text"),
        }
        done = [self.pool.submit(self._add, name, part) for name, part in parts.items()]
        self._add("mapping", self._mapping(at, out, every))
        for job in [counted, *done]:
            job.result()
        state = {"k_words": self.k_words, "at_least": self.at_least, "patterns": [[list(p), *n] for p, n in sorted(self.patterns.items())]}
        self.store.write_text(f"commits/{self.turn}", json.dumps(state))
        self.turn += 1
        at.clear()
        return out

    def _unseen(self, rows: DataFrame) -> DataFrame:
        """Without the articles that an earlier ingest has taken or rejected."""
        if not self.turn:
            return rows
        old = self._all("docs").select("article").unionAll(self._all("rejected").select("article"))
        ids = rows.select((F.col("id") % _SHIFT).alias("article")).distinct()
        # the narrow history meets the batch's ids where it is read; what comes back is at most the batch
        again = old.join(ids, "article", "left_semi").distinct()
        return rows.withColumn("article", F.col("id") % _SHIFT).join(again, "article", "left_anti").drop("article")

    @staticmethod
    def _one_row(sketches: DataFrame) -> DataFrame:
        """An article id counts once: the row with its smallest order number."""
        return sketches.groupBy((F.col("id") % _SHIFT).alias("article")).agg(F.min_by(F.struct("id", "print", "words", "keys", "source_zip"), "id").alias("s")).select("article", "s.*")

    def _candidates(self, pairs: DataFrame, firsts: DataFrame) -> DataFrame:
        """(a, b, pattern, ratio) of the pairs that share keys, a earlier than b, within the batch and with the history.

        The batch's keys are broadcast if their number allows it, and the history's keys are then paired in the tasks
        that read them: a key that many stored texts hold is spread over its files, and counted there before it moves.
        Beyond that size both sides are shuffled, and adaptive execution splits a hot key. Stored texts under one key
        are accepted ones, so none is similar to another: copies never crowd a stored key.
        """
        own = {x: firsts.select(F.col("id").alias(x), F.col("words").alias(f"n_{x}"), F.col("zip").alias(f"zip_{x}")) for x in "ab"}
        found = pairs.join(own["a"], "a").select("a", "b", "bands", "n_a", "zip_a")
        stored = self._all("keys")
        if stored is not None:
            new = bands_of(firsts.select("id", "keys")).select("key", F.col("id").alias("b"))
            new = F.broadcast(new) if firsts.count() * (DARTS // ROWS * ROUNDS) <= PROBE_KEYS else new
            met = stored.select("key", F.col("id").alias("a"), F.col("words").alias("n_a"), F.col("zip").alias("zip_a")).join(new, "key")
            found = found.unionByName(met.groupBy("a", "b").agg(F.count("*").alias("bands"), F.min("n_a").alias("n_a"), F.min("zip_a").alias("zip_a")).where(F.col("bands") >= LEAST_BANDS))
        both = found.join(own["b"], "b")
        ratio = F.least("n_a", "n_b") / F.greatest("n_a", "n_b")
        step = lambda c, steps: sum((F.when(c >= s, 1).otherwise(0) for s in steps), F.lit(0))
        pattern = step(F.col("bands"), _BAND_STEPS) * 100 + step(ratio, _RATIO_STEPS) * 10 + F.col("zip_a").eqNullSafe(F.col("zip_b")).cast("int")
        return both.select("a", "b", pattern.alias("pattern"), ratio.alias("ratio"))

    def _links(self, scored: DataFrame, texts: DataFrame) -> DataFrame:
        """(a, b, sim, pattern, score) of the pairs that the exact check confirms. Checked are those whose weight reaches the
        least one and whose sizes allow the similarity: a set less than `at_least` as large as the other can't be that similar."""
        weights, least = learn_weights(self.patterns)
        listed = F.split(F.lit(",".join(repr(w) for w in weights.values())), ",")  # in the order of the levels
        place = F.floor(F.col("pattern") / 100) * (_LEVELS[1] * _LEVELS[2]) + F.floor(F.col("pattern") / 10) % 10 * _LEVELS[2] + F.col("pattern") % 10
        score = F.get(listed, place.cast("int")).cast("double")
        pairs = scored.where(F.col("ratio") >= self.at_least).select("a", "b", "pattern", score.alias("score")).where(F.col("score") >= F.lit(least))
        return self._check(pairs, texts).join(pairs, ["a", "b"])

    def _count(self, scored: DataFrame, links: DataFrame) -> None:
        """Adds the batch's pairs and confirmed pairs to the pattern counts."""
        seen = scored.select("pattern", F.lit(1).alias("n"), F.lit(0).alias("links")).unionAll(links.select("pattern", F.lit(0), F.lit(1)))
        for r in seen.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("links").alias("links")).collect():  # at most 7 x 5 x 2 patterns
            p = (r["pattern"] // 100, r["pattern"] // 10 % 10, r["pattern"] % 10)
            old = self.patterns.get(p, [0, 0])
            self.patterns[p] = [old[0] + r["n"], old[1] + r["links"]]

    def _check(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
        texts = texts.select("id", "text")
        docs = self._all("docs")
        if docs is not None:
            texts = texts.unionAll(docs.select("id", "text"))
        return verify(pairs, texts.join(wanted, "id", "left_semi").dropDuplicates(["id"]), self.k_words, self.at_least)

    def _hot_links(self, at: Workspace, name: str, star: DataFrame, sketches: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame:
        """The links with those among the pairs (a, b) of hot buckets: at least two shared keys, sizes near enough, not linked yet."""
        a, b = (sketches.select(F.col("id").alias(x), F.col("keys").alias(f"keys_{x}"), F.col("words").alias(f"n_{x}")) for x in "ab")
        both = star.distinct().join(links, ["a", "b"], "left_anti").join(a, "a").join(b, "b")
        near = both.where((F.least("n_a", "n_b") / F.greatest("n_a", "n_b") >= self.at_least) & (F.size(F.array_intersect("keys_a", "keys_b")) >= LEAST_BANDS))
        near = at.write(f"near_{name}", near.select("a", "b"))
        more = self._check(near, texts).withColumn("score", F.lit(None).cast("double"))
        links = at.write(f"links_{name}", links.select("a", "b", "sim", "score").unionAll(more))
        at.drop(f"near_{name}")
        return links

    def _decide(self, at: Workspace, copies: DataFrame, sketches: DataFrame, links: DataFrame, hot: DataFrame | None, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, state, turn) of the linked ids of this batch, state 1 accepted or -1 rejected in that round; and all links found.

        In each round a set is accepted if no earlier undecided or accepted set is linked to it, and
        rejected if an accepted one is. Rounds go on until all are decided: the first undecided set always
        can be. Within a hot bucket the first undecided sets not yet compared with the rest are, one in
        the first round and twice as many in each further one, or as many as LEAD_SQUARES allows: a large family of
        near copies costs one comparison each, sets that are all accepted take as many rounds as the logarithm of their
        number, and a bucket that is hardly hot is through in one or two. Beyond that the rounds are those of the longest alternating chain; where no bucket is hot, two of
        them are one job. What is rejected before an accepted set of its bucket has been compared with it is compared
        afterwards.
        """
        new = copies.select(F.col("rep").alias("id"))
        # a is always the earlier of a pair; ids of earlier ingests are accepted already
        linked = links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id")))
        if hot is not None:
            linked = linked.unionAll(hot.select("id"))
            # led: the round in which the set was compared with all undecided later ones of the bucket, 0 if not yet
            hot = at.write("hot_0", hot.select("key", "id", F.lit(0).alias("led")))
        state = new.join(linked.distinct(), "id", "left_semi").select("id", F.lit(0).alias("state"), F.lit(0).alias("turn"))
        if hot is not None:
            state = at.write("state_0", state)
        for turn in count(1):
            behind = None
            if hot is not None:
                open_ = state.where("state = 0").select("id")
                live = hot.join(open_, "id", "left_semi")
                place = F.row_number().over(W.partitionBy("key").orderBy("id"))
                cheap = F.floor(F.lit(LEAD_SQUARES * buckets.SMALL_BUCKET**2) / F.col("n"))
                block = live.where("led = 0").withColumn("place", place).join(live.groupBy("key").agg(F.count("*").alias("n")), "key").where(F.col("place") <= F.greatest(F.lit(1 << min(turn - 1, 20)), cheap))
                block = at.write(f"block_{turn}", block.select("key", F.col("id").alias("a")))
                if block.limit(1).count():
                    star = live.select("key", F.col("id").alias("b")).join(small(block), "key").where("a < b").select("a", "b")
                    links = self._hot_links(at, str(turn), star, sketches, links, texts)
                    now = block.select("key", F.col("a").alias("id"), F.lit(turn).alias("now"))
                    hot = at.write(f"hot_{turn}", hot.join(now, ["key", "id"], "left").select("key", "id", F.coalesce("now", "led").alias("led")))
                    at.drop(f"hot_{turn - 1}", f"links_{turn - 1}")
                    behind = hot.where("led = 0").join(open_, "id", "left_semi").select("id").distinct()
            judged = self._judged(state, links, turn, behind)
            state = at.write(f"state_{turn}", self._judged(judged, links, turn, None) if hot is None else judged)
            at.drop(f"state_{turn - 1}", f"block_{turn}")
            if state.where("state = 0").isEmpty():
                break
        if hot is not None:
            links = self._hot_links(at, "after", self._uncompared(at, copies, hot, state), sketches, links, texts)
        return state, links

    @staticmethod
    def _judged(state: DataFrame, links: DataFrame, turn: int, behind: DataFrame | None) -> DataFrame:
        """State after one round; `behind` are ids of hot buckets that can't be accepted yet."""
        earlier = links.join(state.select(F.col("id").alias("a"), F.col("state").alias("at_a")), "a", "left").select(F.col("b").alias("id"), F.coalesce("at_a", F.lit(1)).alias("at_a"))
        seen = earlier.groupBy("id").agg(F.max(F.when(F.col("at_a") == 1, 1).otherwise(0)).alias("hit"), F.max(F.when(F.col("at_a") == 0, 1).otherwise(0)).alias("wait"))
        judged, wait = state.join(seen, "id", "left"), F.coalesce("wait", F.lit(0))
        if behind is not None:
            judged = judged.join(behind.withColumn("behind", F.lit(1)), "id", "left")
            wait = F.greatest(wait, F.coalesce("behind", F.lit(0)))
        verdict = F.when(F.col("state") != 0, F.col("state")).when(F.col("hit") == 1, -1).when(wait == 0, 1).otherwise(0)
        return judged.select("id", verdict.alias("state"), F.when((F.col("state") == 0) & (verdict != 0), turn).otherwise(F.col("turn")).alias("turn"))

    @staticmethod
    def _uncompared(at: Workspace, copies: DataFrame, hot: DataFrame, state: DataFrame) -> DataFrame:
        """Pairs (a, b) of an accepted and a rejected set of a hot bucket that no round has compared.

        A set is compared with the later ones that are undecided when it leads. Accepted sets after the
        rejected one matter only to copies of it that come later still.
        """
        kept = at.write("kept", hot.join(state.where("state = 1").select("id", "turn"), "id").select("key", F.col("id").alias("kept"), F.col("led").alias("led_k"), F.col("turn").alias("turn_k")))
        lost = hot.join(state.where("state = -1").select("id", "turn"), "id").join(copies.select(F.col("rep").alias("id"), "copies"), "id")
        lost = lost.select("key", F.col("id").alias("lost"), F.col("led").alias("led_l"), F.col("turn").alias("turn_l"), "copies")
        before = (F.col("kept") < F.col("lost")) & (F.col("led_k") > F.col("turn_l"))
        after = (F.col("kept") > F.col("lost")) & (F.col("copies") > 1) & ((F.col("led_l") == 0) | (F.col("led_l") > F.col("turn_k")))
        return lost.join(small(kept), "key").where(before | after).select(F.least("kept", "lost").alias("a"), F.greatest("kept", "lost").alias("b"))

    @staticmethod
    def _matches(sketches: DataFrame, copies: DataFrame, verdicts: DataFrame, links: DataFrame) -> DataFrame:
        """Every rejected id with the most similar accepted one before it (the smaller article id if equal)."""
        both = links.select(F.col("b").alias("rep"), F.col("a").alias("match"), "sim", "score").unionAll(links.select(F.col("a").alias("rep"), F.col("b").alias("match"), "sim", "score"))
        lost = verdicts.where("state = -1").select(F.col("id").alias("match"))
        both = both.join(lost, "match", "left_anti")
        reps = copies.join(verdicts.select(F.col("id").alias("rep"), "state"), "rep", "left").where("copies > 1 or state = -1")
        members = sketches.select("id", "article", "print").join(reps, "print")
        same = members.where("id <> rep and coalesce(state, 1) = 1").select("id", "article", F.col("rep").alias("match"), F.lit(1.0).alias("sim"), F.lit(None).cast("double").alias("score"))
        near = members.where("state = -1").join(both, "rep").where("match < id").select("id", "article", "match", "sim", "score")
        best = F.struct((-F.col("sim")).alias("s"), (F.col("match") % _SHIFT).alias("m"), "match", "sim", "score")
        return same.unionAll(near).groupBy("id", "article").agg(F.min(best).alias("best")).select("id", "article", "best.match", "best.sim", "best.score")

    def _mapping(self, at: Workspace, rejected: DataFrame, links: DataFrame) -> DataFrame:
        """Union-find step over the clusters that the batch touched; gives their changed rows only.

        Every rejected id stands between accepted ones, whose clusters it unites. Representatives are looked up for the
        touched ids alone; ids between two clusters are the edges of a small graph over representatives, and only
        members of clusters that lose theirs get a new row.
        """
        gone = rejected.select(F.col("id").alias("b"))
        edges = rejected.select("id", "match").unionAll(links.join(gone, "b", "left_semi").select(F.col("b").alias("id"), F.col("a").alias("match")).join(gone.withColumnRenamed("b", "match"), "match", "left_anti").select("id", "match"))
        edges = edges.distinct()
        old = None
        if self.turn:
            touched = edges.select(F.col("match").alias("id")).distinct()
            old = self._all("mapping", True).join(touched, "id", "left_semi").groupBy("id").agg(F.max_by("representative", "turn").alias("representative"))
            edges = edges.join(old.select(F.col("id").alias("match"), "representative"), "match", "left").select("id", "match", F.coalesce("representative", "match").alias("rep"))
        else:
            edges = edges.select("id", "match", F.col("match").alias("rep"))
        edges = at.write("cluster_edges", edges)
        least = edges.groupBy("id").agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
        bridges = edges.join(least.where("least < most"), "id").where("rep > least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()
        if least.where("least < most").isEmpty():
            return edges.select("id", F.col("rep").alias("representative")).unionAll(edges.select(F.col("match").alias("id"), F.col("rep").alias("representative"))).distinct()
        roots = at.write("roots", components(at, at.write("bridges", bridges)))
        moved = edges.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select("id", "match", F.coalesce("root", "rep").alias("representative"))
        out = moved.select("id", "representative").unionAll(moved.select(F.col("match").alias("id"), "representative"))
        if old is not None:
            changed = roots.where("id <> root").select(F.col("id").alias("representative"), "root")
            members = self.mapping().join(changed, "representative").select("id", F.col("root").alias("representative"))
            out = out.unionAll(members)
        return out.distinct()


def rejected_articles(articles: DataFrame, batches: DataFrame, path: str, archives: int = 30) -> DataFrame:
    """(id, article, match, sim, score) over a whole archive: its batches go in by batch_no, `archives` of them in the first
    ingest and in each further one as many as have gone in before, so the stored keys are scanned as often as the logarithm
    of the number of archives and all ingests together read a few times what is stored.

    articles: (id, source_zip, text); batches: (source_zip, batch_no), one row per archive; path: the store. The
    result is the same for any number of archives an ingest. Articles of no listed archive come last.
    """
    spark, at = articles.sparkSession, Workspace(articles.sparkSession, "arrivals")
    numbers = batches.where("source_zip is not null").groupBy("source_zip").agg(F.min("batch_no").alias("batch_no"))
    # a manifest has one row per archive; equal numbers fall into one ingest
    part = F.floor((F.dense_rank().over(W.orderBy(F.col("batch_no").asc_nulls_last())) - 1) / archives).cast("bigint")
    # parts 0, 1, 2-3, 4-7 and so on: the number of binary digits
    place = F.when(part > 0, F.length(F.bin(part))).otherwise(0)
    numbers = at.write("numbers", numbers.withColumn("run", F.when(F.col("batch_no").isNotNull(), place)))
    runs = numbers.agg(F.max("run")).first()[0]
    runs = 1 if runs is None else runs + 1
    arrivals = articles.join(small(numbers), "source_zip", "left").withColumn("run", F.coalesce("run", F.lit(runs - 1)))
    # articles as they lie in the archives of each ingest: an ingest reads its own
    arrivals.select("id", "source_zip", "text", "batch_no", "run").write.option("compression", "zstd").partitionBy("run").parquet(at.path("arrivals"))
    there = spark.read.schema("id int, source_zip string, text string, batch_no int, run int").parquet(at.path("arrivals"))
    deduper = IncrementalDeduper(spark, path)
    for run in range(runs):
        deduper.ingest(there.where(F.col("run") == run).drop("run"))
    at.clear()
    return deduper.rejected()
