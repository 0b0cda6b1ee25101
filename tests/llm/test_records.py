import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import consensus, mixing, overlap, sampling

# ---- overlaps

ROWS = "row_id long, post_id string, text string, source string, split_name string, key string, folded string"


def training(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS)


def slow_alike(a, b):
    """Longest common subsequence by its table."""
    x, y = overlap.fold(a).split(), overlap.fold(b).split()
    table = np.zeros((len(x) + 1, len(y) + 1), int)
    for i, u in enumerate(x):
        for j, v in enumerate(y):
            table[i + 1, j + 1] = table[i, j] + 1 if u == v else max(table[i, j + 1], table[i + 1, j])
    return bool(x and y) and table[-1, -1] >= 0.75 * max(len(x), len(y))


def test_pairs_equal_all_pairs(spark):
    random.seed(4)
    words = [f"từ{i}" for i in range(300)]
    rows, texts = [], []
    for _ in range(40):
        texts.append(" ".join(random.choice(words) for _ in range(random.choice([1, 2, 4, 9, 20, 60, 150]))))
    for t in texts[:25]:
        w = t.split()
        for _ in range(len(w) // 8):
            w[random.randrange(len(w))] = "khác"
        texts += [" ".join(w).upper() + "!!", t.replace("từ", "ｔừ"), t + " thêm"]
    texts += [None, "", "  ", "!!!", texts[0], "a" * 9000, " ".join(random.choice(words) for _ in range(4000))]
    for i, t in enumerate(texts):
        rows.append((i, random.choice([None, "", " ", f"p{i % 30}"]), t, "s", ("train", "val", "test", "other")[i % 4]))
    want = set()
    for a in rows:
        for b in rows:
            if a[4] == "train" and b[4] in ("val", "test"):
                same = a[1] == b[1] and a[1] and a[1].strip()
                if same or (a[2] and b[2] and a[2].strip() and b[2].strip() and slow_alike(a[2], b[2])):
                    want.add((a[0], b[0]))
    for light in (0, 10**9):
        got = {(r.train_key, r.key) for r in overlap.overlaps(training(spark, rows), shard=50, light=light).collect()}
        assert got == want and len(want) > 30
    counts = {r.key: r.pairs for r in overlap.partners(training(spark, rows)).collect()}
    assert counts == {r[0]: sum(k == r[0] for _, k in want) for r in rows if r[4] in ("val", "test")}


def test_edited_copies_of_a_common_text_are_pairs(spark):
    random.seed(8)
    base = [f"chung{i}" for i in range(60)]

    def variant(name):
        w = list(base)
        for i in random.sample(range(60), 6):
            w[i] = f"{name}{i}"
        return " ".join(w)

    rows = [(i, None, variant(f"cũ{i}x"), "s", "train") for i in range(80)]
    rows += [(1000 + i, None, variant(f"mới{i}x"), "s", ("val", "test")[i % 2]) for i in range(4)]
    rows += [(2000 + i, None, " ".join(f"riêng{i}x{k}" for k in range(40)), "s", ("train", "val")[i % 2]) for i in range(100)]
    want = {(a[0], b[0]) for a in rows[:80] for b in rows[80:84] if slow_alike(a[2], b[2])}
    for shard, light in ((7, 0), (4000, 0), (4000, 10**9), (30, 50)):
        got = {(r.train_key, r.key) for r in overlap.overlaps(training(spark, rows), shard=shard, light=light).collect()}
        assert got == want and len(want) == 320


def test_no_row_is_repeated_for_the_texts_it_meets(spark, monkeypatch):
    plans, real = [], overlap.stored

    def kept(df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, *args)

    monkeypatch.setattr(overlap, "stored", kept)
    rows = [(1, None, "a b c d", "s", "train"), (2, None, "a b c e", "s", "val")]
    assert overlap.overlaps(training(spark, rows), light=0).count() == 1
    assert len(plans) > 3 and not any("Generate" in plan for plan in plans)


def test_pairs_of_long_texts(spark):
    random.seed(13)
    rows = []
    for i, n in enumerate((250, 300, 500, 520, 1000, 1100, 2100)):
        words = [f"dài{random.randrange(400)}" for _ in range(n)]
        edited = [f"khác{k}" if random.random() < 0.12 else w for k, w in enumerate(words)]
        rows += [(i, None, " ".join(words), "s", "train"), (100 + i, None, " ".join(edited), "s", "val"), (200 + i, None, " ".join(words[: n * 4 // 5]), "s", "test")]
    want = {(a[0], b[0]) for a in rows for b in rows if a[4] == "train" and b[4] != "train" and overlap.alike(overlap.fold(a[2]), overlap.fold(b[2]))}
    for light in (0, 10**9):
        got = {(r.train_key, r.key) for r in overlap.overlaps(training(spark, rows), light=light).collect()}
        assert got == want and len(want) == 14


def test_chat_spellings_and_reports(spark):
    base = "Mình không biết kể với ai nên lên đây, hụi ở Thượng Mây vỡ đúng hôm sinh nhật rồi mọi người ạ"
    rows = [(1, "a", base, "s", "train"), (2, "b", base.replace("không", "ko").replace("mọi người", "mn").replace("Mình", "Mk"), None, "val"), (3, "a", None, "s", "test"), (4, None, "chuyện khác hẳn", "s", "test")]
    frame = training(spark, rows)
    pairs = overlap.overlaps(frame)
    assert {(r.train_key, r.key) for r in pairs.collect()} == {(1, 2), (1, 3)}
    report = {(r.split_name, r.source): (r.rows, r.overlapping, r.pairs) for r in overlap.report(frame).collect()}
    assert report == {("val", None): (1, 1, 1), ("test", "s"): (2, 1, 1)}
    covered = {r.row_id: (r.partners, r.covered) for r in overlap.coverage(frame).collect()}
    assert covered == {2: (1, pytest.approx(1.0)), 4: (0, 0.0)}


def test_coverage_by_longer_and_several_texts(spark):
    words = [f"w{i}" for i in range(80)]
    rows = [(1, None, " ".join(words), "s", "train"), (2, None, " ".join(f"v{i}" for i in range(80)), "s", "train")]
    rows += [(3, None, " ".join(words[20:60]), "s", "val"), (4, None, " ".join(words[:20] + [f"v{i}" for i in range(20)]), "s", "test"), (5, None, " ".join(f"u{i}" for i in range(40)), "s", "test")]
    for shard in (5, 40_000):
        covered = {r.row_id: (r.partners, r.covered) for r in overlap.coverage(training(spark, rows), shard=shard).collect()}
        assert covered[3] == (0, pytest.approx(1.0)) and covered[4][0] == 0 and covered[4][1] > 0.85 and covered[5] == (0, 0.0)


def test_overlaps_of_nothing(spark):
    assert overlap.overlaps(training(spark, [])).isEmpty()
    assert overlap.overlaps(training(spark, [(1, None, None, None, "train"), (2, "", "", None, "val")])).isEmpty()


# ---- consensus

VALIDATION = "post_id string, qwen_aspects array<int>, claude_aspects array<int>, rater string"
ANNOTATIONS = "post_id string, annotator_id string, aspects array<int>, mask int"


def planted(spark, n=300, seed=3):
    rng = random.Random(seed)
    truth = {f"p{i}": {a for a in range(9) if rng.random() < 0.2} for i in range(n)}

    def vote(labels, right):
        return [a for a in range(9) if (a in labels) == (rng.random() < right)] + [99, -1]

    validation = [(p, vote(t, 0.9), None if rng.random() < 0.1 else vote(t, 0.93), "x") for p, t in truth.items()]
    people = {"good": 0.95, "fair": 0.85, "guess": 0.5, "bad": 0.25}
    votes = [(p, who, vote(t, right), 1) for p, t in truth.items() for who, right in people.items() if rng.random() < 0.8]
    votes += votes[:20] + [(None, "good", [1], 1), ("p0", None, [1], 1), ("p1", "fair", None, 1), ("unasked", "good", [1], 1)]
    return truth, spark.createDataFrame([*validation, *validation[:5]], VALIDATION), spark.createDataFrame(votes, ANNOTATIONS)


def test_consensus_is_nearer_to_the_truth_than_any_rater(spark):
    truth, validation, annotations = planted(spark)
    cast = consensus.votes(validation, annotations)
    model, packed = consensus.fit(cast)
    assert model.converged and model.rounds < consensus.ROUNDS
    got = {}
    for r in consensus.posteriors(model, packed).collect():
        if r.chance > 0.5:
            got.setdefault(r.post_id, set()).add(r.aspect_id)
    wrong = sum(len(got.get(p, set()) ^ t) for p, t in truth.items()) / (9 * len(truth))
    assert wrong < 0.03
    rated = {r.rater: r for r in consensus.reliabilities(model, spark).filter("aspect_id IS NULL").collect()}
    assert abs(rated["good"].sensitivity - 0.95) < 0.05 and abs(rated["bad"].specificity - 0.25) < 0.08 and abs(rated["guess"].informedness) < 0.15
    assert rated["good"].sensitivity_low < rated["good"].sensitivity < rated["good"].sensitivity_high


def test_digamma():
    assert consensus.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890], abs=1e-8)


def test_krippendorff(spark):
    rows = [("a", "x", 1), ("a", "y", 1), ("b", "x", 0), ("b", "y", 0), ("c", "x", 1), ("c", "y", 0), ("d", "x", 1)]
    got = consensus.krippendorff(spark.createDataFrame(rows, "post_id string, rater string, mask int"), n=1).filter("aspect_id = 0").first()
    # 6 values, 3 ones: observed 2 of 6, expected 2 * 3 * 3 / 5 of 6
    assert got["items"] == 3 and got.alpha == pytest.approx(1 - 2 / (2 * 3 * 3 / 5))


def test_consensus_of_nothing(spark):
    cast = consensus.votes(spark.createDataFrame([("p", None, None, None)], VALIDATION), spark.createDataFrame([], ANNOTATIONS))
    assert consensus.posteriors(*consensus.fit(cast)).isEmpty() and consensus.krippendorff(cast).isEmpty()


# ---- samples

TARGETS = "plan_name string, category int, target_share double, min_rows int, sample_fraction double"


def test_samples_match_their_targets(spark):
    rows = [(f"p{i}", [i % 7, 3] if i % 11 else None) for i in range(2000)] + [("p1", [1, 3]), (None, [2]), ("tail", [8]), ("out", [9, -3])]
    labeled = spark.createDataFrame([(*r, "x", 1) for r in rows], "post_id string, aspects array<int>, category string, bucket int")
    targets = [("plan", c, 0.1, 3, 0.2) for c in range(-1, 9)] + [("none", 0, None, 1, 0.5), (None, 0, 0.5, 1, 0.5), ("floor", 8, 0.0, 5, 0.1), ("floor", 2, 0.01, 40, 0.1)]
    found = sampling.posts(labeled)
    assert found.count() == 2002
    report = sampling.needs(found, spark.createDataFrame(targets, TARGETS))
    unmet = {(r.plan_name, r.category) for r in report.filter("NOT met").collect()}
    assert unmet == {("plan", 7), ("plan", 8), ("floor", 8)}
    drawn = sampling.draw(found, report).join(found.withColumnRenamed("category", "own"), "post_id").collect()
    assert all(r.category == r.own for r in drawn) and len({(r.plan_name, r.post_id) for r in drawn}) == len(drawn)
    counts = {}
    for r in drawn:
        counts[r.plan_name, r.category] = counts.get((r.plan_name, r.category), 0) + 1
    for r in report.collect():
        assert r.take <= counts.get((r.plan_name, r.category), 0) <= max(r.take, r.target_share * r.size + 1)
    short = {(r.plan_name, r.category): (r.drawn, r.posts) for r in sampling.outcome(report, sampling.draw(found, report)).filter("NOT met").collect()}
    assert set(short) == unmet and all(drawn_ == posts for drawn_, posts in short.values())
    again = sampling.draw(found, report, seed=8).collect()
    assert {(r.plan_name, r.post_id) for r in again} != {(r.plan_name, r.post_id) for r in drawn}


def test_samples_of_nothing(spark):
    found = sampling.posts(spark.createDataFrame([], "post_id string, aspects array<int>"))
    report = sampling.needs(found, spark.createDataFrame([("p", 0, 0.5, 2, 0.5)], TARGETS))
    assert report.first().met is False and sampling.draw(found, report).isEmpty()


# ---- mixtures

MIX = "source string, target_weight double, max_repeats int"


def test_mixture_keeps_weights_and_caps(spark):
    random.seed(2)
    rows = [(i, random.choices(["big", "mid", None, "other"], [6, 2, 1, 1])[0], "một hai ba bốn " * random.randint(1, 30)) for i in range(900)] + [(1000 + i, "tiny", "năm sáu " * 5) for i in range(5)] + [(2000, "big", None), (2001, "mid", "")]
    documents = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, source string, text string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.2, 4), ("gone", 0.1, 2), (None, 0.4, 1), ("bad", None, None)], MIX)
    copies, report = mixing.mix(documents, targets)
    got = {r.source: r for r in report.collect()}
    assert got["tiny"].most_copies == 4 and got["tiny"].limited and not got["tiny"].met and not got["gone"].met and got["bad"].actual_tokens == 0
    assert got["big"].most_copies == 1 and got["mid"].most_copies <= 3
    assert got["big"].actual_share / got["mid"].actual_share == pytest.approx(5 / 3, rel=0.02)
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1)
    assert copies.filter("copies < 1").isEmpty() and copies.groupBy("doc_id").count().filter("count > 1").isEmpty()
    assert copies.filter(F.col("doc_id").isin(2000, 2001)).isEmpty()


def test_pivot_keeps_mass_and_expectation():
    total, n = np.zeros(2), 4000
    for seed in range(n):
        done, open_ = mixing.pivot(("a", 3, 0.4), ("b", 5, 0.7), seed)
        pair = {done[0]: done, open_[0]: open_}
        assert 3 * pair["a"][2] + 5 * pair["b"][2] == pytest.approx(3 * 0.4 + 5 * 0.7) and min(done[2], 1 - done[2]) < 1e-9
        total += [pair["a"][2], pair["b"][2]]
    assert total / n == pytest.approx([0.4, 0.7], abs=0.02)


def test_allotment_fills_what_caps_leave():
    assert mixing.allot({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5, "c": 1.0}, {"a": 1, "b": 5, "c": 2}, 300) == {"c": 0.0, "a": 100.0, "b": 200.0}


def test_mixture_of_nothing(spark):
    copies, report = mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string"), spark.createDataFrame([("a", 1.0, 1)], MIX))
    assert copies.isEmpty() and report.first().actual_tokens == 0
