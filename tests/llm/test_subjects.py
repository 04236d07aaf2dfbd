import random

import numpy as np
import pyarrow as pa
import pytest

from vellumic.llm import subjects as S

WORDS = {"law": "court judge plea verdict statute counsel".split(), "music": "sonata violin tempo chorus bow drum".split(), "cookery": "onion flour oven broth dough pan".split()}
FRAMES = ["The {} stood near the {} on Monday.", "Without the {} there was no {} at all!", "They asked why the {} was like a {};", "Every {} had some {} by evening."]
SHEET = ["Marked for review because the margin is faint.", "A stain hides the heading below."]


def corpus(n, seed):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        a, b = rng.sample(list(WORDS), 2)
        mainly, other, sheet = rng.randint(5, 9), rng.choice([0, 0, 1, 6]), rng.randint(0, 3)
        say = lambda c: rng.choice(FRAMES).format(*rng.sample(WORDS[c], 2))
        parts = [say(a) for _ in range(mainly)] + [say(b) for _ in range(other)] + [rng.choice(SHEET) for _ in range(sheet)]
        rng.shuffle(parts)
        docs.append((i, " ".join(parts)))
        truth[i] = {c for c, m in ((a, mainly), (b, other)) if m >= 2 and m >= 0.2 * len(parts)}
    return docs, truth


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_held_out_accuracy(spark, seed):
    docs, truth = corpus(600, seed)
    rng = random.Random(seed)
    labels = [(i, a) for i, _ in docs[:200] for a in sorted(truth[i])]
    labels = [(i, rng.choice(sorted(WORDS)) if rng.random() < 0.05 else a) for i, a in labels] + [(99_999, "law"), (3, "no such area")]
    df = spark.createDataFrame(docs + [(10_000, None), (10_001, ""), (10_002, "...")], "doc_id long, text string")
    coded = S.features(df, spark.createDataFrame(labels, "doc_id long, subject_area string"))
    got = {(r.doc_id, r.subject_area) for r in S.classify(coded, S.fit(coded, sorted(WORDS))).collect()}
    want = {(i, a) for i, s in truth.items() if i >= 200 for a in s}
    held = {x for x in got if x[0] >= 200}
    assert len(held & want) / len(want) > 0.98 and len(held & want) / len(held) > 0.98
    assert not any(i >= 10_000 for i, _ in got)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "A judge read the plea. The court rose."), (1, "A judge read the plea. The court rose."), (None, "One more. And more.")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, subject_area string")
    for docs, areas in ((df, []), (df, ["law"]), (df.limit(0), ["law"])):
        coded = S.features(docs, labels)
        assert S.classify(coded, S.fit(coded, areas)).count() == 0
    assert S.features(df, None).count() == 3


def test_sentences():
    assert S.sentences(None) == [] and S.sentences("... 12!") == []
    assert S.sentences("One two. Three four!\n\nFive six") == [["one", "two"], ["three", "four"], ["five", "six"]]
    assert S.sentences("On 22.4.1933: the end; then on") == [["on", "the", "end"], ["then", "on"]]
    assert len(S.sentences("Some words here. " * 50_000)) == 50_000


def coded(texts):
    rows = [S.encode(t) for t in texts]
    return S.Batch.of(pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int32())))


def test_batch_sums_equal_loops():
    rng = np.random.default_rng(0)
    texts = [t for _, t in corpus(20, 4)[0]] + [None, "zzz"]
    batch = coded(texts)
    model = S.Model(["a", "b", "c"], rng.normal(size=(S.BUCKETS, 3)), np.ones(3), np.zeros(3))
    shares = model.shares(batch)
    assert shares.shape == (len(batch.doc), 4) and np.allclose(shares.sum(axis=1), 1)
    c = S.Counts(3)
    c.add(batch, shares[:, :3])
    want = np.zeros((S.BUCKETS, 3))
    for w, s in zip(batch.word, batch.at):
        want[w] += shares[s, :3]
    assert np.allclose(c.sentence, want)
    allowed = np.ones((batch.docs, 3))
    allowed[0] = [0, 1, 0]
    limited = model.shares(batch, allowed=allowed)
    assert np.allclose(limited[batch.doc == 0][:, [0, 2]], 0) and np.allclose(limited.sum(axis=1), 1)


def test_every_word_has_a_feature():
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}x" for i in range(100)]
    assert all(0 <= S.feature(w) < S.BUCKETS for w in words) and len({S.feature(w) for w in words}) > 95
    assert S.encode("one two one. three") == (sorted_pair("one", "two") + [S.feature("three")], [2, 1])


def sorted_pair(*words):
    return list({S.feature(w) for w in words})


def test_calibration_finds_the_crossing():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 3, 5000)
    y = (rng.random(5000) < 1 / (1 + np.exp(-(0.8 * x - 1)))).astype(float)
    a, b = S.calibrate(x, y, np.ones(5000))
    assert a == pytest.approx(0.8, abs=0.1) and b == pytest.approx(-1, abs=0.15)
    edges = np.linspace(-12, 12, 500)
    at = np.digitize(x, edges)
    n = np.bincount(at, minlength=501)
    keep = n > 0
    c, d = S.calibrate((np.r_[edges, 12] - 0.024)[keep], (np.bincount(at, weights=y, minlength=501)[keep] / n[keep]), n[keep])
    assert (c, d) == pytest.approx((a, b), abs=0.05)
