import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainledger.operators import evaluation, graph, learning, metrics, panel, places, relations, similarity
from rainledger.operators.extraction import parse_answers
from rainledger.operators.graph import components
from rainledger.storage import Workspace


def test_greedy_keeps_the_far_end_of_a_chain(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (4, 5, 0.95), (4, 6, 0.9), (5, 6, 0.99)], "a long, b long, sim double")
    ids = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    got = {r["id"]: r["kept_id"] for r in similarity.keep_greedily(pairs, ids).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None, 5: 4, 6: 4, 7: None}


def test_greedy_rounds_have_no_cap(spark, monkeypatch):
    monkeypatch.setattr(similarity, "range", lambda *a: range(1, 3), raising=False)
    chain = spark.range(1, 7).selectExpr("id a", "id + 1 b", "0.9D sim")
    got = {r["id"]: r["kept_id"] for r in similarity.keep_greedily(chain, spark.range(1, 8).toDF("id")).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: 5, 7: None}


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(40)) for _ in range(20)]
    texts += [t + " x" for t in texts[:8]] + [texts[0], texts[0], None, "", "kort"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sets = {i: ({" ".join(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()) for i, w in ((i, (t or "").split()) for i, t in enumerate(texts))}
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    want = {(first[frozenset(s)], i) for i, s in sets.items() if s and first[frozenset(s)] != i}
    reps = [i for i, s in sets.items() if s and first[frozenset(s)] == i]
    want |= {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.88}
    assert {(r["a"], r["b"]) for r in similarity.similar_pairs(df).collect()} == want


@pytest.mark.parametrize("one_task", [0, 100])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK_EDGES", one_task)
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 51), (51, 52), (52, 50), (7, 7)]
    got = {r["id"]: r["root"] for r in components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {50: 50, 51: 50, 52: 50}
    assert components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_average_precision_of_ties_and_one_label(spark):
    rows = [("tie", 1, 0.5), ("tie", 0, 0.5), ("tie", 0, 0.5), ("best", 1, 0.9), ("best", 0, 0.1), ("none", 0, 0.3), ("all", 1, 0.3)]
    df = spark.createDataFrame(rows, "k string, y int, s double")
    assert {r["k"]: r["ap"] for r in metrics.average_precision(df, ["k"], "y", "s").collect()} == {"tie": 1 / 3, "best": 1.0, "none": None, "all": None}
    assert {r["k"]: r["auc"] for r in metrics.roc_auc(df, ["k"], "y", "s").collect()} == {"tie": 0.5, "best": 1.0, "none": None, "all": None}


def test_panel_is_gap_free_and_folds_do_not_leak(spark):
    g = panel.grid(spark.createDataFrame([("a",), ("b",), ("a",)], "r string"), "r", "2018-01-01", "2020-12-01")
    assert g.count() == 2 * 36
    folds = panel.expanding_folds(g, 1, [2018, 2019, 2020, 2030])
    assert panel.leaks(folds).count() == 0 and {r["valid_year"] for r in folds.select("valid_year").distinct().collect()} == {2019, 2020}


def test_cascade_branches_and_weights(spark):
    regions = spark.createDataFrame([("X1", 2, "Noord", None), ("X11", 3, "Stad", "X1"), ("X12", 3, "Land", "X1"), ("X2", 2, "Leeg", None)], "nuts_id string, level int, name string, parent_id string")
    index = places.name_index(regions, spark.createDataFrame([("X11", "De Stee")], "nuts_id string, alias string"))
    m = spark.createDataFrame([(1, "x", None, 1.0, "nl", "city"), (2, "x", 1.0, 1.0, "de", "city"), (3, "x", 1.0, 1.0, "", "country"), (4, "stee", 1.0, 1.0, "nl", "city"), (5, "NOORD", 1.0, 1.0, None, "city"), (6, "x", 1.0, 1.0, "NL", "city"), (7, "x", 1.0, 1.0, "nl", "city"), (8, "Leeg", 1.0, 1.0, "nl", "city")], "row_id long, location string, latitude double, longitude double, country_code string, place_level string").withColumn("home", F.lit("nl"))
    located = spark.createDataFrame([(6, "X12", "near")], "row_id long, region_id string, how string")
    got = {}
    for r in places.assign_regions(m, index, located).collect():
        got.setdefault(r["row_id"], []).append((r["branch"], r["region_id"], r["weight"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {1: [("none", None, 1.0)], 2: [("abroad", None, 1.0)], 3: [("country", None, 1.0)], 4: [("name", "X11", 1.0)], 5: [("name", "X11", 0.5), ("name", "X12", 0.5)], 6: [("near", "X12", 1.0)], 7: [("none", None, 1.0)], 8: [("name", "X2", 1.0)]}


def test_candidates_widen_only_for_weak_ones(spark):
    rows = [("a", "global", 0, 1, "city"), ("a", "nl", 0, 2, "state"), ("b", "global", 0, 3, "hamlet"), ("b", "nl", 0, 4, "town"), ("c", "global", 0, 5, "village"), ("c", "global", 1, 6, None)]
    got = {r["mention"]: r["osm_id"] for r in places.pick_candidates(spark.createDataFrame(rows, "mention string, scope string, pos int, osm_id long, addresstype string")).collect()}
    assert got == {"a": 1, "b": 4, "c": 5}


def test_validation_is_all_or_nothing(spark):
    good = '{"events": [{"location": "P", "recency_in_months": 0, "impacts": [{"classification": "Wetland Loss", "severity": 2, "evidence": "x", "confidence": 0.5}]}]}'
    cases = [good, good.replace("0.5", "0.9"), good.replace('"severity": 2', '"severity": 4'), good.replace('"P"', '" "'), good.replace('"x"', f'"{"x" * 701}"'), good.replace("Wetland", "Moon"), '{"events": [{"location": "P", "recency_in_months": 0}]}', "no", "Error: x", "{}", None]
    got = [(r["error"] is None, len(r["events"])) for r in parse_answers(spark.createDataFrame(list(enumerate(cases)), "i int, p string"), "p").orderBy("i").collect()]
    assert got == [(True, 1)] + [(False, 0)] * 8 + [(True, 0), (False, 0)]


def test_multisets_and_upsert(spark):
    g = spark.createDataFrame([(1, "a"), (1, "a"), (1, None)], "k int, v string")
    p = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, v string")
    assert {tuple(r) for r in relations.multiset_match(g, p, ["v"], ["k"]).collect()} == {(1, 3, 2, 2), (2, 0, 1, 0)}
    assert sorted(map(tuple, relations.upsert(g.distinct(), spark.createDataFrame([(1, "z")], "k int, v string"), ["k"]).collect())) == [(1, "z")]


def _panel(spark, n=240):
    rng = random.Random(2)
    rows = [(i, c, 2018 + i % 4, x, rng.random(), 1.0, int(x + rng.gauss(0, 0.2) > 0.5) if c == "a" else 0) for i in range(n) for c in "ab" for x in [rng.random()]]
    return spark.createDataFrame(rows, "i int, class string, target_year int, x double, z double, one double, y int")


def test_models_learn_on_held_out_rows_and_skip_single_labels(spark):
    rows = _panel(spark)
    split = rows.withColumn("part", F.when(F.col("target_year") < 2021, "train").otherwise("valid"))
    held = learning.fit_predict(split, ["x", "z", "one"], ["class"], ["i"], 1.0)
    scores = metrics.evaluated(held, ["class"], "y", "y_score").collect()
    assert [r["class"] for r in scores] == ["a"] and scores[0]["auc"] > 0.9 and scores[0]["n"] == 60
    macro = metrics.macro_means(metrics.evaluated(held, ["class"], "y", "y_score"), []).first()
    assert macro["n_classes"] == 1 and macro["macro_auc"] == scores[0]["auc"]
    parts = {r["feature"]: r["mean_attribution"] for r in learning.attribution_summary(learning.attributions(rows, ["x", "z", "one"])).collect()}
    assert parts["x"] > 3 * parts["z"] and parts["one"] == 0


def test_logistic_is_a_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=300) > 0.3).astype(int)
    m = learning.Logistic(0.5).fit(x, y)
    z, w = (x - m.mean) / m.scale, np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    p = m.score(x)
    assert np.abs(z.T @ (w * (p - y)) + m.coefficients / 0.5).max() < 1e-3 and abs((w * (p - y)).sum()) < 1e-3


def test_trials_prune_and_pick(spark):
    found = learning.trials(_panel(spark), ["x", "z"], [2019, 2020, 2021], [{"c": 1.0}, {"c": 1e-6}]).cache()
    table = {r["trial"]: r for r in learning.trial_table(found).collect()}
    assert table[0]["n_folds"] == 3 and table[0]["score"] > 0.8 and sorted(r["place"] for r in table.values()) == [1, 2]
    assert [r["class"] for r in learning.best_per_class(found).collect()] == ["a"]
    prevalence = {r["class"]: r["prevalence"] for r in learning.class_prevalence(_panel(spark), [2019, 2020]).collect()}
    assert prevalence["b"] == 0 and 0.3 < prevalence["a"] < 0.7
    steps = spark.createDataFrame([("p", 1, 0.1), ("p", 2, 0.2), ("q", 1, 0.5), ("q", 2, 0.6), ("r", 1, 0.4), ("r", 2, 0.5)], "r string, k int, s double")
    assert {(r["r"], r["k"]) for r in metrics.pruned_runs(steps, "r", "k", "s").where("pruned").collect()} == {("p", 2)}


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_trees_learn_on_held_out_rows(spark, kind):
    rows = _panel(spark, 400).where("class = 'a'")
    held = learning.fit_trees(rows.where("target_year < 2021"), rows.where("target_year = 2021"), ["x", "z"], "y", kind)
    assert metrics.roc_auc(held.withColumn("k", F.lit(1)), ["k"], "y", "y_score").first()["auc"] > 0.85


def test_feature_subsets():
    m = {"a": ["x", "y"], "b": ["z"]}
    assert learning.subsets(m, {"a": ["y"], "b": True}) == ["y", "z"] and learning.subsets(m, {"a": False}) == []
    with pytest.raises(ValueError):
        learning.subsets(m, {"a": ["q"]})


def medoids_by_force(rows, at_least=0.44, shortest=200):
    out = set()
    for cluster in {c for c, _, _ in rows}:
        own = sorted({(i, t) for c, i, t in rows if c == cluster})
        sets = {i: {" ".join(t.lower().split()[k : k + 3]) for k in range(max(1, len(t.split()) - 2))} if len(t or "") >= shortest else set() for i, t in own}
        sim = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] and sets[j] else 0.0  # noqa: E731, B023
        left, used = [i for i, _ in own], set()
        while len(left) > 1 and (free := [i for i in left if i not in used]):
            best = max(free, key=lambda i: (round(sum(sim(i, j) for j in left if j != i) / (len(left) - 1), 12), -i))
            gone = [j for j in left if j != best and sim(best, j) >= at_least]
            if not gone:
                break
            out |= {(cluster, j, best) for j in gone}
            left, used = [j for j in left if j not in gone], used | {best}
    return out


def test_medoids_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("water droogte boer rivier peil regen dijk sloot".split()) + str(rng.randrange(40))
    rows = []
    for c in range(4):
        bases = [[word() for _ in range(60)] for _ in range(3)]
        for k in range(14):
            t = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 9)):
                t[rng.randrange(60)] = word()
            rows.append((c, 100 * c + k, " ".join(t)))
        rows += [(c, 100 * c + 50 + k, rows[-1][2]) for k in range(3)] + [(c, 100 * c + 60, "kort"), (c, 100 * c + 61, "kort"), (c, 100 * c + 62, "")]
    df = spark.createDataFrame(rows, "cluster long, id long, text string")
    assert {tuple(r) for r in similarity.medoid_duplicates(df).collect()} == medoids_by_force(rows)
    assert similarity.medoid_duplicates(df.limit(0)).count() == 0


def test_points_match_by_stages(spark):
    box = lambda x, y, w, h: [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]
    regions = spark.createDataFrame([("P", 2, "p", None, box(5.0, 52.0, 0.4, 0.2)), ("A", 3, "a", "P", box(5.0, 52.0, 0.2, 0.2)), ("Q", 2, "q", None, box(7.0, 52.0, 0.2, 0.2))], "nuts_id string, level int, name string, parent_id string, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(1, 52.1, 5.1), (2, 52.1, 5.3), (3, 52.1, 4.9), (4, 52.1, 7.3), (5, 40.0, 5.0), (6, None, 5.0)], "k long, lat double, lon double")
    got = {r["k"]: tuple(r)[1:] for r in places.match_points(points, regions, "k", "lat", "lon").collect()}
    assert got[1] == ("inside", "A", "P", 0) and got[2] == ("inside_parent", None, "P", 0)
    assert got[3][:3] == ("near", "A", "P") and 6000 < got[3][3] < 7000 and got[4][:3] == ("near_parent", None, "Q") and set(got) == {1, 2, 3, 4}


def test_removal_report_names_empty_texts(spark):
    rows = spark.createDataFrame([(1, "een twee drie vier vijf zes"), (2, "een twee drie vier vijf zes"), (3, " "), (4, None)], "id long, text string")
    assert {tuple(r) for r in similarity.removal_report(rows, similarity.similar_pairs(rows)).collect()} == {(2, 1, 1.0, "near_duplicate"), (3, None, None, "empty_text"), (4, None, None, "empty_text")}


def test_small_tables_of_a_report(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0), (None, 5.0)], "k string, v double")
    d = relations.describe(rows, ["v"]).first()
    assert (d["n"], d["n_null"], d["mean"], d["median"]) == (3, 1, 3.0, 3.0)
    both = relations.null_safe_join(rows.groupBy("k").count(), rows.groupBy("k").agg(F.max("v").alias("m")), ["k"])
    assert {r["k"]: r["m"] for r in both.collect()} == {"a": 1.0, "b": 3.0, None: 5.0}
    assert relations.seeded_sample(spark.range(100), "id", 10, 1).count() == 10 and 5 < relations.seeded_fraction(spark.range(200), "id", 0.1, 1).count() < 40
    r = evaluation.recalls(spark.createDataFrame([("m", 1, 1, 0, 0)], "m string, a_tp int, a_fn int, b_tp int, b_fn int"), "m", ["a", "b"]).first()
    assert r["a_recall"] == 0.5 and r["b_recall"] is None and r["overall_recall"] == 0.5
