import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxdesk.operators import joins, ranking, roc, sizing, splits


def brute_split(rows, fraction, seed="42"):
    """Test ids of a stratified split of (id, label) rows, by sorting each class."""
    import hashlib
    import math

    classes = {}
    for i, label in rows:
        classes.setdefault(label, []).append(i)
    total, wanted = len(rows), math.ceil(fraction * len(rows))
    quota = {c: wanted * len(ids) // total for c, ids in classes.items()}
    rest = sorted(classes, key=lambda c: (-(wanted * len(classes[c]) % total), c))
    for c in rest[: wanted - sum(quota.values())]:
        quota[c] += 1
    key = lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i)
    return {i for c, ids in classes.items() for i in sorted(ids, key=key)[: quota[c]]}


def labelled(spark, rows, parts=4):
    return spark.createDataFrame(rows, "doc_id long, label string").repartition(parts)


def hot_rows(n=3000):
    draw = random.Random(1)
    return [(i, "hot" if draw.random() < 0.4 else draw.choice("abcde")) for i in range(n)]


@pytest.mark.parametrize("fraction", [0.2, 0.37])
def test_stratified_split_equals_sorting_each_class(spark, fraction):
    rows = hot_rows()
    out = splits.safe_split(labelled(spark, rows), "label", fraction).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"] for r in out if r["split"] == "test"} == brute_split(rows, fraction)


def test_split_does_not_follow_partitioning(spark):
    rows = hot_rows(500)
    tags = [
        {r["doc_id"]: r["split"] for r in splits.safe_split(labelled(spark, rows, p), "label").collect()}
        for p in (1, 7)
    ]
    assert tags[0] == tags[1]


@pytest.mark.parametrize(
    "counts,reason,test_rows",
    [
        ({"a": 6, "b": 4}, "stratified", 2),
        ({"a": 6, "b": 3, "c": 1}, "class_below_two", 2),
        ({"a": 3, "b": 3, "c": 3}, "test_below_classes", 2),
        ({}, "class_below_two", 0),
    ],
)
def test_split_plan(spark, counts, reason, test_rows):
    rows = [(f"{c}{i}", c) for c, n in counts.items() for i in range(n)]
    df = spark.createDataFrame([(n, c) for n, (_, c) in enumerate(rows)], "doc_id long, label string")
    plan = splits.plan_split(df, "label", 0.2)
    assert (plan.reason, plan.test_rows) == (reason, test_rows)
    tagged = splits.safe_split(df, "label", 0.2)
    assert tagged.where("split = 'test'").count() == test_rows
    assert tagged.count() == len(rows)


def test_split_quotas(spark):
    df = labelled(spark, [(i, "a" if i < 6 else "b") for i in range(10)])
    out = splits.safe_split(df, "label", 0.2).where("split = 'test'")
    assert sorted(r["label"] for r in out.collect()) == ["a", "b"]


def test_null_labels_are_kept(spark):
    rows = [(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(100)]
    out = splits.safe_split(labelled(spark, rows), "label")
    assert out.count() == 100
    assert out.where("split = 'test'").count() == 20


def test_nested_split_parts(spark):
    rows = hot_rows(500)
    out = splits.nested_split(labelled(spark, rows), "label").collect()
    sizes = {}
    for r in out:
        sizes[r["split"]] = sizes.get(r["split"], 0) + 1
    assert sorted(r["doc_id"] for r in out) == list(range(500))
    assert sizes == {"test": 100, "val": 80, "train": 320}


def test_sample_sizes(spark):
    df = labelled(spark, hot_rows(50))
    assert splits.sample_n(df, 7, id_col="doc_id").count() == 7
    assert splits.sample_n(df, 50, id_col="doc_id").count() == 50
    assert splits.sample_n(df, 51, id_col="doc_id").count() == 50
    assert splits.sample_n(df, 0, id_col="doc_id").count() == 0


def test_folds_cover_classes_in_id_order(spark):
    rows = hot_rows(1001)
    out = splits.assign_folds(labelled(spark, rows), "label").collect()
    assert len(out) == 1001
    for label in {r["label"] for r in out}:
        folds = [r["fold"] for r in sorted(out, key=lambda r: r["doc_id"]) if r["label"] == label]
        assert folds == sorted(folds)
        sizes = [folds.count(f) for f in range(3)]
        assert max(sizes) - min(sizes) <= 1
    whole = [sum(r["fold"] == f for r in out) for f in range(3)]
    assert whole == [334, 334, 333]


def test_folds_of_a_class_smaller_than_k(spark):
    rows = [(0, "a"), (1, "b"), (2, "b"), (3, "b"), (4, "b")]
    out = {r["doc_id"]: r["fold"] for r in splits.assign_folds(labelled(spark, rows), "label").collect()}
    # class-sorted positions: a=0, b=1..4, so b has 1, 2 and 1 rows in folds 0 to 2
    assert out == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_folds_of_a_class_that_skips_the_first_fold(spark):
    rows = [(0, "b"), (1, "b"), (2, "b"), (3, "b"), (4, "a")]
    out = {r["doc_id"]: r["fold"] for r in splits.assign_folds(labelled(spark, rows), "label").collect()}
    # b takes positions 0 to 3, the only a stands at position 4
    assert out == {0: 0, 1: 0, 2: 1, 3: 2, 4: 1}


@pytest.mark.parametrize("rows_per_bucket", [3, 50, 10**6])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_sorting(spark, rows_per_bucket, descending):
    draw = random.Random(2)
    data = [
        (g, float(v), draw.randint(0, 9))
        for g in "xy"
        for v in draw.sample(range(-500, 500), 120 if g == "x" else 30)
    ]
    df = spark.createDataFrame(data, "g string, v double, n long").repartition(3)
    out = ranking.running_totals(df, ["g"], "v", ["n"], descending, rows_per_bucket).collect()
    got = {(r["g"], r["v"]): (r["n_upto"], r["n_total"], r["n_next"]) for r in out}
    want = {}
    for g in "xy":
        mine = sorted([d for d in data if d[0] == g], key=lambda d: d[1], reverse=descending)
        total, so_far = sum(d[2] for d in mine), 0
        for i, d in enumerate(mine):
            so_far += d[2]
            want[(g, d[1])] = (so_far, total, mine[i + 1][2] if i + 1 < len(mine) else None)
    assert got == want


def scores(spark, rows):
    return spark.createDataFrame([(float(s), bool(p)) for s, p in rows], "score double, positive boolean")


@pytest.mark.parametrize(
    "rows,auc",
    [
        ([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], 0.75),
        ([(0.5, 0), (0.5, 1)], 0.5),
        ([(0.5, 1), (0.7, 1)], None),
    ],
)
def test_auc_golden(spark, rows, auc):
    assert roc.roc_auc(scores(spark, rows), []).first()["auc"] == auc


@pytest.mark.parametrize("rows_per_bucket", [4, 10**6])
def test_auc_and_curve_agree_with_pair_counting(spark, rows_per_bucket):
    draw = random.Random(3)
    rows = [(draw.choice([0.0, round(draw.random(), 2)]), draw.random() < 0.4) for _ in range(300)]
    df = scores(spark, rows)
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert roc.roc_auc(df, [], rows_per_bucket).first()["auc"] == pytest.approx(want, abs=1e-12)
    flipped = df.withColumn("score", -F.col("score"))
    assert roc.roc_auc(flipped, [], rows_per_bucket).first()["auc"] == pytest.approx(1 - want, abs=1e-12)

    full = roc.roc_points(df, [], False, rows_per_bucket).collect()
    bends = roc.roc_points(df, [], True, rows_per_bucket).collect()
    assert len(full) == len({s for s, _ in rows}) + 1

    def area(points):
        line = sorted((r["fpr"], r["tpr"]) for r in points)
        return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(line, line[1:]))

    assert area(full) == pytest.approx(want, abs=1e-12)
    assert area(bends) == pytest.approx(want, abs=1e-12)
    assert len(bends) < len(full)


def test_small_side_over_the_limit_is_not_broadcast(spark):
    small = spark.createDataFrame([(i, "x" * 50) for i in range(100)], "k long, v string")
    big = spark.range(1000).withColumnRenamed("id", "k")
    for limit, hinted in ((1 << 20, True), (100, False)):
        joined = big.join(sizing.small_side(small, limit), "k")
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) is hinted
        assert joined.count() == 100


@pytest.mark.parametrize("rows_per_bucket", [1, 5, 10**6])
def test_odd_scores_count_alike_at_every_size(spark, rows_per_bucket):
    inf, nan = float("inf"), float("nan")
    scored = [(0.1, False), (0.4, False), (0.4, True), (0.8, True), (inf, True), (-inf, False), (-inf, True)]
    odd = [(None, True), (nan, False)]
    df = spark.createDataFrame(scored + odd, "score double, positive boolean")
    pairs = [(p, n) for p, a in scored if a for n, b in scored if not b]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    assert roc.roc_auc(df, [], rows_per_bucket).first()["auc"] == pytest.approx(want, abs=1e-12)


def test_folds_of_text_ids(spark):
    df = spark.createDataFrame([(f"id{i:03d}", "ab"[i % 2]) for i in range(30)], "doc_id string, y string")
    rows = splits.assign_folds(df, "y", 3).collect()
    assert sorted(r["fold"] for r in rows) == [0] * 10 + [1] * 10 + [2] * 10


def test_ids_of_one_prefix_fall_into_even_buckets(spark):
    ids = [(f"ticket-number-{i:05d}",) for i in range(4000)]
    heavy = [("ticket-number-02000",)] * 3000
    df = spark.createDataFrame(ids + heavy, "id string").repartition(4)
    rows = ranking.value_buckets(df, "id", rows_per_bucket=200).collect()
    sizes = Counter(r["bucket"] for r in rows)
    own = {r["bucket"] for r in rows if r["id"] == heavy[0][0]}
    assert len(own) == 1 and len(sizes) > 20
    assert {r["id"] for r in rows if r["bucket"] in own} == {heavy[0][0]}
    assert max(n for b, n in sizes.items() if b not in own) < 800
    assert [r["id"] for r in sorted(rows, key=lambda r: (r["bucket"], r["id"]))] == sorted(r["id"] for r in rows)


def test_labels_of_one_prefix_are_numbered_in_order(spark):
    names = [f"label with a long prefix é {i:04d}" for i in range(1500)]
    df = spark.createDataFrame([(n,) for n in names], "y string").repartition(3)
    found = joins.label_map(df, "y", rows_per_bucket=50).orderBy("label_id").collect()
    assert [r["label"] for r in found] == names
    assert [r["label_id"] for r in found] == list(range(1500))


def test_large_label_sides_are_sifted_by_a_bloom_filter(spark):
    messages = spark.createDataFrame([(i, f"text {i}") for i in range(300)] + [(300, None), (301, "")], "message_id long, text string")
    labels = spark.createDataFrame([(f"text {i}",) for i in range(0, 900, 3)] + [(None,)], "text string")
    plain = joins.unlabelled(messages, labels)
    sifted = joins.unlabelled(messages, labels, limit_bytes=100)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, sifted.collect()))
    assert plain.count() == 201
    plan = sifted._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Union" in plan


def test_quotas_of_many_labels_need_no_window_over_all(spark):
    n = 100_000
    counts = spark.range(n).select(
        F.format_string("label %06d", "id").alias("y"), (F.col("id") % 3 + 2).alias("n")
    ).repartition(5)
    sizes = {f"label {i:06d}": i % 3 + 2 for i in range(n)}
    total = sum(sizes.values())
    wanted = total // 4
    quota = {y: wanted * m // total for y, m in sizes.items()}
    rest = sorted(sizes, key=lambda y: (-(wanted * sizes[y] % total), y))
    for y in rest[: wanted - sum(quota.values())]:
        quota[y] += 1
    found = splits.class_quotas(counts, "y", wanted)
    assert {r["y"]: r["target"] for r in found.collect()} == quota
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString().replace("Subquery", "")


def test_sums_before_follow_any_order(spark):
    rows = [(i, i * 7 % 50, f"c{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, n long, c string").repartition(6)
    found = ranking.sums_before(df, F.struct(F.col("n"), F.col("c")), "id", "before").collect()
    ordered, total, want = sorted(rows, key=lambda r: (r[1], r[2])), 0, {}
    for i, _, c in ordered:
        want[c], total = total, total + i
    assert {r["c"]: r["before"] for r in found} == want
    assert ranking.nth_place(df, F.col("c"), 201).collect() == []
    assert ranking.nth_place(df, F.col("c"), 3).first()[0] == sorted(r[2] for r in rows)[2]
