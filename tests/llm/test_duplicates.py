import random

import numpy as np
from helpers import edited, sim, text

from rainledger.llm import near_duplicates, pairs
from rainledger.llm.incremental import IncrementalDeduper, learn_weights, rejected_articles
from rainledger.llm.near_duplicates import near_duplicate_groups
from rainledger.llm.shingles import DartMinHash, Shingler, mix, similarity
from rainledger.storage import Workspace


def fresh(spark):
    return Workspace(spark, "t").path("store")


def deduper(spark):
    return IncrementalDeduper(spark, fresh(spark))


def corpus():
    rows = []
    for f in range(12):
        base = text(f)
        rows += [(len(rows) + j, edited(base, 100 * f + j, j)) for j in range(5)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (501, rows[0][1]), (600, None), (601, ""), (602, "te kort"), (603, "te kort"), (None, rows[0][1]), (604, "lang " * 60_000 + text(99)), (605, "lang " * 60_000 + text(99) + " eind")]
    return rows


def groups_by_force(rows, k, t):
    texts = {i: x for i, x in rows if i is not None and x}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sim(texts[a], texts[b], k) >= t:
                root[max(find(a), find(b))] = min(find(a), find(b))
    sizes = {}
    for i in texts:
        sizes[find(i)] = sizes.get(find(i), 0) + 1
    return sorted((find(i), i) for i in texts if sizes[find(i)] > 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 7, "k") for i, x in rows], "id int, text string, print int, key string")


def test_dart_signatures_estimate_plain_and_weighted_similarity():
    base = np.unique(mix(np.arange(300, dtype=np.uint64)))
    other = np.unique(np.concatenate([base[:200], mix(base[200:])]))
    s = DartMinHash(4000)([base, other])
    assert abs((s[0] == s[1]).mean() - similarity(base, other)) < 0.03
    rng = np.random.default_rng(1)
    w, v = rng.uniform(0.1, 9, 300), rng.uniform(0.1, 9, 300)
    s = DartMinHash(4000)([base, base], [w, v])
    assert abs((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.03
    # a signature doesn't depend on the batch
    assert (DartMinHash(50)([base])[0] == DartMinHash(50)([other[:20], base])[1]).all()


def test_shingles_and_short_texts():
    assert len(Shingler(3)("een twee drie")) == 0 and len(Shingler(3)(None)) == 0
    assert len(Shingler(3)(" ".join(["a"] * 25))) == 1


def test_groups_equal_brute_force(spark):
    rows = corpus()
    got = sorted(tuple(r) for r in near_duplicate_groups(frame(spark, rows)).collect())
    assert got == groups_by_force(rows, 3, 0.7)


def test_groups_of_hot_buckets_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SMALL_BUCKET", 4)
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 7)
    base = text(1)
    rows = [(i, edited(base, i, 1)) for i in range(30)] + [(100 + i, edited(edited(base, 5, 9), i, 1)) for i in range(20)]
    got = sorted(tuple(r) for r in near_duplicates.near_duplicate_groups(frame(spark, rows)).collect())
    assert got == groups_by_force(rows, 3, 0.7)
    # chains that leave the first set's reach step by step, and sets that share a template but no group
    rows = [(i, marked(text(2, 300), *range(5, 5 + 4 * i, 4))) for i in range(40)] + [(100 + i, text(3, 60) + " " + text(50 + i, 50)) for i in range(25)]
    got = sorted(tuple(r) for r in near_duplicates.near_duplicate_groups(frame(spark, rows)).collect())
    assert got == groups_by_force(rows, 3, 0.7) and len({g for g, _ in got}) >= 1
    assert near_duplicate_groups(frame(spark, [])).count() == 0


def rejected_by_force(rows, order, k=5, t=0.8):
    seen, out, accepted = set(), {}, []
    for b, i, z, x in sorted((order.get(z, 2**31), i, z, x) for i, z, x in rows if i is not None and x is not None):
        if i in seen:
            continue
        seen.add(i)
        best = max(((sim(x, y, k), -j) for j, y in accepted), default=(0, 0))
        if best[0] >= t:
            out[i] = -best[1]
        else:
            accepted.append((i, x))
    return out


def test_rejections_equal_a_walk_for_any_number_of_ingests(spark, monkeypatch):
    random.seed(2)
    rows = [(i, random.choice(["z1", "z2", "z3", "z4", None]), x) for i, x in corpus() if i != 501] + [(501, "z2", corpus()[0][1]), (501, "z2", corpus()[0][1])]
    rows += [(700 + i, random.choice(["z1", "z3"]), edited(text(3), 900 + i, 1 + i % 3)) for i in range(25)]
    order = {"z1": 3, "z2": 1, "z3": 2, "z4": 4}
    articles = spark.createDataFrame([(i, z, x, 1) for i, z, x in rows], "id int, source_zip string, text string, batch_no_x int")
    batches = spark.createDataFrame(list(order.items()), "source_zip string, batch_no int")
    want = rejected_by_force(rows, order)
    for archives, bucket in ((9, 64), (1, 64), (2, 4)):
        monkeypatch.setattr(pairs, "SMALL_BUCKET", bucket)
        got = {r["id"] % 2**32: r["match"] % 2**32 for r in rejected_articles(articles, batches, fresh(spark), archives).collect()}
        assert got == want, (archives, bucket)


def test_ingests_of_an_archive_follow_the_logarithm_of_its_batches(spark, monkeypatch):
    taken, ingest = [], IncrementalDeduper.ingest
    monkeypatch.setattr(IncrementalDeduper, "ingest", lambda self, batch: taken.append(sorted(r["id"] for r in batch.select("id").collect())) or ingest(self, batch))
    rows = [(i, f"z{i}", text(i % 8)) for i in range(1, 10)]
    articles, batches = spark.createDataFrame(rows, "id int, source_zip string, text string"), spark.createDataFrame([(z, i) for i, z, _ in rows], "source_zip string, batch_no int")
    got = {r["article"]: r["match"] % 2**32 for r in rejected_articles(articles, batches, fresh(spark), 1).collect()}
    assert got == {9: 1} and taken == [[1], [2], [3, 4], [5, 6, 7, 8], [9]]


def test_a_hardly_hot_bucket_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SMALL_BUCKET", 8)
    base, names, write = text(6, 1000), [], Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, name, *a: names.append(name) or write(self, name, *a))
    rows = [(i, edited(base, i, 15)) for i in range(16)]
    batch = spark.createDataFrame([(i, 1, "z", x) for i, x in rows], "id int, batch_no int, source_zip string, text string")
    got = {r["id"] % 2**32: r["match"] % 2**32 for r in deduper(spark).ingest(batch).collect()}
    assert got == rejected_by_force([(i, "z", x) for i, x in rows], {"z": 1}) and "hot" in names
    assert sum(n.startswith("block_") for n in names) <= 2


def marked(base, *places):
    """The text with the words at these places replaced."""
    words = base.split()
    for p in places:
        words[p] = f"anders{p}"
    return " ".join(words)


def test_hot_family_of_two_accepted_texts(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SMALL_BUCKET", 4)
    base, places = text(5, 600), range(20, 580, 40)
    near = [marked(base, *[p for p in places if p != gone]) for gone in places]
    # 1 and 40 are accepted, all others are more like 40 than like 1; 3 comes before 40, its copy 70 after it
    rows = [(1, base), (40, marked(base, *places)), (70, near[0])] + [(3 + i + 40 * (i > 9), x) for i, x in enumerate(near)]
    batch = spark.createDataFrame([(i, 1, "z", x) for i, x in rows], "id int, batch_no int, source_zip string, text string")
    got = {r["id"] % 2**32: r["match"] % 2**32 for r in deduper(spark).ingest(batch).collect()}
    assert got == rejected_by_force([(i, "z", x) for i, x in rows], {"z": 1}) and got[3] == 1 and got[70] == got[53] == 40


def test_rounds_of_a_hot_bucket_do_not_follow_its_size(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SMALL_BUCKET", 4)
    base, names, write = text(6, 1000), [], Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, name, *a: names.append(name) or write(self, name, *a))
    rows = [(i, edited(base, i, 15)) for i in range(24)]
    assert not rejected_by_force([(i, "z", x) for i, x in rows], {})
    batch = spark.createDataFrame([(i, 1, "z", x) for i, x in rows], "id int, batch_no int, source_zip string, text string")
    assert deduper(spark).ingest(batch).count() == 0
    assert 2 < sum(n.startswith("state_") for n in names) <= 7


def test_history_is_not_read_again_and_mapping_follows(spark):
    d = deduper(spark)
    a = text(1)
    schema = "id int, batch_no int, source_zip string, text string"
    assert d.ingest(spark.createDataFrame([(1, 1, "z", a), (2, 1, "z", text(2))], schema)).count() == 0
    out = d.ingest(spark.createDataFrame([(3, 2, "y", edited(a, 1, 1)), (4, 2, "y", text(4))], schema)).collect()
    assert [(r["id"] % 2**32, r["match"] % 2**32) for r in out] == [(3, 1)] and out[0]["score"] is not None
    assert {r["id"] % 2**32: r["representative"] % 2**32 for r in d.mapping().collect()} == {1: 1, 3: 1}
    assert d.ingest(spark.createDataFrame([], schema)).count() == 0


def test_a_batch_that_bridges_two_clusters_moves_all_their_members(spark):
    d, a = deduper(spark), text(8)
    b = marked(a, 20, 60)
    schema = "id int, batch_no int, source_zip string, text string"
    d.ingest(spark.createDataFrame([(1, 1, "z", a), (2, 1, "z", b), (3, 1, "z", marked(a, 40)), (4, 1, "z", marked(b, 40))], schema))
    assert {r["id"] % 2**32: r["representative"] % 2**32 for r in d.mapping().collect()} == {1: 1, 3: 1, 2: 2, 4: 2}
    d.ingest(spark.createDataFrame([(5, 2, "z", marked(a, 20))], schema))
    assert {r["id"] % 2**32: r["representative"] % 2**32 for r in d.mapping().collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1}


def test_learned_weights_rise_with_agreement_and_leave_out_hopeless_patterns():
    w, least = learn_weights({(0, 1, 0): [500_000, 0], (1, 1, 0): [300, 2], (5, 3, 0): [8_000_000, 7_999_000], (6, 4, 0): [30_000_000, 30_000_000], (6, 4, 1): [2_000_000, 2_000_000]})
    assert w[(6, 4, 0)] > w[(5, 3, 0)] > w[(0, 1, 0)] and w[(0, 1, 0)] < least <= w[(5, 3, 0)]
    assert learn_weights({})[1] == learn_weights({(0, 0, 0): [9, 0]})[1] == float("-inf")


SCHEMA = "id int, batch_no int, source_zip string, text string"


def ids(df):
    return sorted((r["id"] % 2**32, r["match"] % 2**32) for r in df.collect())


def test_a_store_is_continued_by_another_deduper_and_unfinished_ingests_are_not_seen(spark):
    path, a = fresh(spark), text(1)
    IncrementalDeduper(spark, path).ingest(spark.createDataFrame([(1, 1, "z", a), (2, 1, "z", text(2))], SCHEMA))
    second = IncrementalDeduper(spark, path)
    second.store.write("keys/turn=1", spark.createDataFrame([(1, 1, 1, 1)], "key long, id long, words int, zip long"))  # died before its commit
    assert second.turn == 1 and ids(second.ingest(spark.createDataFrame([(3, 2, "y", edited(a, 1, 1)), (4, 2, "y", text(4))], SCHEMA))) == [(3, 1)]
    third = IncrementalDeduper(spark.newSession(), path)
    assert third.turn == 2 and third.patterns == second.patterns and sum(n for _, n in third.patterns.values()) == 1
    assert {r["id"] % 2**32: r["representative"] % 2**32 for r in third.mapping().collect()} == {1: 1, 3: 1} and third.accepted().count() == 3


def test_an_article_that_comes_again_later_is_neither_a_copy_of_itself_nor_taken_twice(spark):
    d = deduper(spark)
    d.ingest(spark.createDataFrame([(1, 1, "z1", text(1)), (2, 1, "z1", edited(text(1), 3, 1))], SCHEMA))
    assert d.ingest(spark.createDataFrame([(1, 2, "z2", text(1)), (2, 2, "z2", edited(text(1), 3, 1)), (3, 2, "z2", text(3))], SCHEMA)).count() == 0
    assert ids(d.rejected()) == [(2, 1)] and sorted(r["article"] for r in d.accepted().collect()) == [1, 3]


def test_clusters_merge_by_way_of_a_later_batch(spark):
    d, a = deduper(spark), text(8)
    b = marked(a, 20, 60)
    d.ingest(spark.createDataFrame([(1, 1, "z", a), (2, 1, "z", b)], SCHEMA))
    d.ingest(spark.createDataFrame([(7, 2, "z", marked(a, 20, 60, 70))], SCHEMA))
    assert {r["id"] % 2**32: r["representative"] % 2**32 for r in d.mapping().collect()} == {2: 2, 7: 2}
    d.ingest(spark.createDataFrame([(9, 3, "z", marked(a, 20))], SCHEMA))
    assert {r["id"] % 2**32: r["representative"] % 2**32 for r in d.mapping().collect()} == {1: 1, 2: 1, 7: 1, 9: 1}
