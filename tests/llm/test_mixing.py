import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vellumic.llm import mixing as M


def brute(docs, targets, total, keys):
    """Whole epochs, then documents by key while they bring the source nearer to its budget."""
    by = defaultdict(list)
    for d, s, n, _ in docs:
        if n:
            by[s].append((d, n))
    out = {}
    for s, share, cap in targets:
        have = sum(n for _, n in by[s])
        budget = min(math.floor(share * total), have * cap)
        epochs = budget // have if have else 0
        rest, cum = budget - epochs * have, 0
        for d, n in sorted(by[s], key=lambda x: (keys[x[0]], x[0])):
            before, cum = cum, cum + n
            extra = int(before < rest and cum - n / 2 <= rest)
            if epochs + extra:
                out[d] = epochs + extra
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice("aaabc") if i % 11 else None, rng.choice([0, 1, 7, 40, 300]), rng.choice([0.1, 0.5, 1.0])) for i in range(4000)]
    targets = [("a", 0.3, 2), ("b", 0.5, 2), ("c", 0.15, 1), ("none", 0.05, 9)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, quality double")
    taken, goal = M.mix(sized, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    keys = {r[0]: r[1] for r in sized.select("doc_id", M.exponential_key(F.col("doc_id"), F.col("quality"))).collect()}
    total = sum(n for _, _, n, _ in docs)
    got = {r.doc_id: r.copies for r in taken.collect()}
    assert got == brute(docs, targets, total, keys)
    rows = {r.source: r for r in M.shares(taken, goal).collect()}
    assert set(rows) == {"a", "b", "c", "none", None} and rows[None].target_share is None and rows["none"].tokens == 0
    assert rows["none"].shortfall_share == pytest.approx(0.05) and all(r.most_copies <= (r.max_repeats or 0) for r in rows.values())
    assert abs(rows["a"].tokens - 0.3 * total) <= 300 and sum(r.actual_share for r in rows.values()) == pytest.approx(1, abs=1e-5)
    again, _ = M.mix(sized.repartition(7), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    assert {r.doc_id: r.copies for r in again.collect()} == got


def test_heavier_documents_come_first(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25).alias("quality"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("n_tokens"))
    taken, _ = M.mix(df, spark.createDataFrame([("s", 0.1, 1)], "source string, target_share double, max_repeats int"))
    heavy = taken.where("doc_id % 2 = 0").count() / taken.count()
    assert heavy == pytest.approx(0.78, abs=0.04)  # first draws go by weight: 1 / 1.25, a little less as heavy ones run out


def test_tokens_and_edges(spark):
    df = spark.createDataFrame([(1, "a", 1.0, "two words"), (2, "a", 1.0, ""), (3, None, 1.0, None), (4, "a", 1.0, "x " * 50_000), (5, "a", 1.0, "<|endoftext|>")], "doc_id long, source string, quality double, text string")
    sized = {r.doc_id: r.n_tokens for r in M.token_counts(df, "text").collect()}
    assert sized[1] == 2 and sized[2] == 0 and sized[3] == 0 and sized[4] >= 50_000 and sized[5] > 1
    weights = [r[0] for r in df.select(M.quality(F.col("text"))).collect()]
    assert weights[0] == 1.0 and weights[1] == weights[2] == 0.1
    empty = M.token_counts(df.limit(0), "text")
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int")
    taken, goal = M.mix(empty, targets)
    assert taken.count() == 0 and M.shares(taken, goal).collect()[0].tokens == 0
    taken, goal = M.mix(M.token_counts(df, "text"), targets, total=10**9)
    assert {r.copies for r in taken.collect()} == {3}
