import datetime
import hashlib
import itertools
import random

from pyspark.sql import functions as F

from tidewell.operators import curation, feeds, labeling, metrics, rollups, similar, topk
from tidewell.operators.scoring import hashed_scorer, predict


def test_stratified_split_sizes(spark):
    rows = spark.createDataFrame([(f"a{i}", 1) for i in range(9)] + [("b", 2)] + [(f"c{i}", None) for i in range(100)], "k string, s int")
    got = {(r.s, r.split_part): r["count"] for r in curation.stratified_split(rows, "s", "k", "x").groupBy("s", "split_part").count().collect()}
    assert got == {(1, "train"): 7, (1, "test"): 2, (2, "test"): 1, (None, "train"): 80, (None, "val"): 10, (None, "test"): 10}


def test_samples_and_gaps(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(31)], "k int, s int")
    assert curation.exact_sample(rows, "k", 0.2, "x").count() == 6
    wanted = spark.createDataFrame([(0, 5), (1, 0), (2, 40)], "s int, n int")
    assert {r.s: r["count"] for r in curation.resampled(rows, "s", "k", wanted, "x").groupBy("s").count().collect()} == {0: 5, 2: 40}
    plan = curation.gap_plan(spark.createDataFrame([(0, 7), (1, 0)], "aspect_id int, cnt long"), 55, 0.1).orderBy("aspect_id").collect()
    assert [(r.target, r.gap, r.augment, r.generate) for r in plan] == [(5, 0, 0, 0), (5, 5, 2, 3)]
    weights = curation.class_weights(spark.createDataFrame([(0, 0), (1, 1), (2, 900)], "aspect_id int, cnt long"), 900, 9).orderBy("aspect_id").collect()
    assert [r.weight for r in weights] == [1.0, 20.0, 1.0]


def test_append_new_keeps_repeats_of_new_keys(spark):
    old, new = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3), ("b", 4), (None, 5)], "k string, v int")
    assert sorted(r.v for r in curation.append_new(old, new, "k").collect()) == [1, 3, 4, 5]


def test_set_measures(spark):
    rows = spark.createDataFrame([([], []), ([1, 2], [2, 1]), ([1], [2, 3])], "a array<int>, b array<int>").withColumns(metrics.set_columns(F.col("a"), F.col("b"))).collect()
    assert [(r["diff"], r.jaccard, r.same) for r in rows] == [(0, 1.0, True), (0, 1.0, True), (3, 0.0, False)]


def test_scores_and_kappa(spark):
    counts = spark.createDataFrame([(0, 0, 0, 5), (4, 1, 1, 4), (0, 2, 3, 0)], "tp long, fp long, fn long, tn long")
    got = metrics.kappa(metrics.scores(counts)).collect()
    assert (got[0].precision, got[0].recall, got[0].f1, got[0].kappa) == (0, 0, 0, 1.0)
    assert (got[1].precision, got[1].kappa) == (0.8, 0.6)
    assert got[2].f1 == 0 and got[2].kappa < 0


def test_rollups(spark):
    rows = spark.createDataFrame([("a", [1, 1, 2], True), ("a", [], False), ("b", [2], True), ("b", None, None)], "g string, v array<int>, stressed boolean").withColumn("confidence", F.lit(0.5))
    got = {r.g: (r.total_cnt, r.stress_cnt, r.pct_stress) for r in rollups.totals(rows, ["g"]).collect()}
    assert got == {"a": (2, 1, 50.0), "b": (2, 1, 50.0)}
    pairs = {(r.aspect_a, r.aspect_b): r.cnt for r in rollups.pairs(rows, "v").collect()}
    assert pairs == {(1, 1): 4, (1, 2): 2, (2, 1): 2, (2, 2): 2}
    steps = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.3), (4, 0.2), (5, 0.9)], "o int, m double")
    assert rollups.best_epoch(steps, "o", "m", 0.01, 2).first().best_step == 2
    assert rollups.best_epoch(steps, "o", "m", 0.01, 3).first().best_step == 5


def test_top_lists(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("b", 2, "w")], "k string, t int, v string")
    assert {r.k: r.t for r in topk.upserted(rows.select("k", "t"), "k", F.col("t")).collect()} == {"a": 3, "b": 2}
    assert {(r.k, r.v) for r in topk.latest_by(rows, ["k"], [F.desc("t"), F.asc("v")], 1).collect()} == {("a", "y"), ("b", "w")}


def test_near_duplicates_against_all_pairs(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(3, 40))) for _ in range(25)]
    for t in list(texts[:12]):
        tokens = t.split()
        tokens[len(tokens) // 2] = "changed"
        texts += [t, " ".join(tokens), t + " more"]
    texts += [None, "", "  ", "short"]
    rows = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "id int, t string, node string")

    def cut(t):
        w = [x for x in t.lower().split() if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {t: cut(t) for t in {t for t in texts if t and cut(t)}}
    near = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    parent = {t: t for t in sets}

    def root(t):
        return t if parent[t] == t else root(parent[t])

    for a, b in near:
        parent[root(a)] = root(b)
    want = {}
    for i, t in enumerate(texts):
        mates = [j for j, u in enumerate(texts) if u == t or t in sets and u in sets and root(u) == root(t)]
        want[i] = (min(mates) if t is not None else i, sum(t in p for p in near))
    got = {r.id: (r["class"], r.links) for r in similar.near_duplicates(rows, "id", "t").collect()}
    assert got == want


def test_scorer(spark):
    rows = spark.createDataFrame([(1, "một hai ba"), (2, None), (3, "  "), (4, "x " * 20000)], "id int, t string")
    got = {r.id: r.p for r in rows.select("id", predict(F.col("t"), hashed_scorer, "test-1").alias("p")).collect()}
    assert got[2].aspects == [] and got[3].confidence == 0.0 and len(got[2].aspect_probs) == 9
    assert all((p > 0.5) == (i in got[1].aspects) for i, p in enumerate(got[1].aspect_probs))


def test_failures_of_scorers_and_labelers_are_told(spark):
    def broken():
        def score(texts):
            raise ValueError("no model")

        return score

    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    got = {r.id: r.p for r in rows.select("id", predict(F.col("t"), broken, "broken-1").alias("p")).collect()}
    assert got[1].failed == "ValueError: no model" and got[2].failed is None and not got[1].stressed
    assert [r.a for r in rows.select(labeling.reply(F.col("t"), broken, "broken-2").alias("a")).collect()] == [None, None]
    ids, confidence = labeling.labels_of(F.col("t"))
    odd = spark.createDataFrame([('<think>{}</think> {"aspects": [3, 3, 12, 1], "confidence": 7}',), ("none",), (None,)], "t string")
    assert [(list(r.i), r.c) for r in odd.select(ids.alias("i"), confidence.alias("c")).collect()] == [([1, 3], 1.0), ([], None), ([], None)]


def test_exact_sample_takes_the_first_of_the_order(spark):
    rows = spark.createDataFrame([(i % 700, i) for i in range(1000)], "k int, v int")
    got = [r.k for r in curation.exact_sample(rows, "k", 0.25, "x").collect()]
    order = sorted((hashlib.md5(f"x|{i % 700}".encode()).hexdigest(), i % 700) for i in range(1000))
    assert sorted(got) == sorted(k for _, k in order[:250])
    assert curation.exact_sample(rows.limit(0), "k", 0.25, "x").isEmpty() and curation.exact_sample(rows, "k", 1.0, "x").count() == 1000
    drawn = curation.resampled(rows.withColumn("s", F.lit(1)), "s", "k", spark.createDataFrame([(1, 25)], "s int, n int"), "y", chunk=4)
    assert sorted(r.slot for r in drawn.collect()) == list(range(1, 26))


def test_feeds(spark):
    at = datetime.datetime(2026, 1, 8, 12, tzinfo=datetime.UTC)
    rows = spark.createDataFrame([(h, "m" if h % 2 else None, [h % 3], at - datetime.timedelta(hours=h)) for h in (0, 1, 5, 30, 200)], "h int, m string, a array<int>, at timestamp")
    hours = lambda df: sorted(r.h for r in df.collect())
    assert hours(feeds.recent(rows, "at", "1h")) == [0, 1] and hours(feeds.recent(rows, "at", "7d")) == [0, 1, 5, 30]
    assert hours(feeds.recent(rows, "at", "24h", at - datetime.timedelta(hours=4))) == [5]
    assert hours(feeds.selected(rows, {"m": "All"}, {"h": []}, {"a": None})) == [0, 1, 5, 30, 200]
    assert hours(feeds.selected(rows, {"m": "m"}, {"h": [1, 30]}, {"a": [1, 7]})) == [1]
    assert feeds.recent(rows.limit(0), "at", "1h").isEmpty()
    assert spark.range(1).select(feeds.bucket_time(F.lit("no hour")).alias("t")).first().t is None
