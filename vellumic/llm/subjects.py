"""Subject areas of each document (problem 8).

Complement naive Bayes over the words of sentences, fitted by expectation-maximization. Every round rates the
sentences of all documents and counts their words anew; in a labelled document a sentence may belong only
to the document's labels or to no area, in every round. The evidence of a sentence for an area is calibrated to
a posterior of its own per area (independent sigmoids), so a sentence may be about no area at all; the
sigmoids are fitted on the sentences of labelled documents, each with the share that the label leaves it.
A document is about an area if at least ``SHARE`` of its sentences, and ``LEAST`` of them, are.

Size: words are hashed to ``BUCKETS`` features, so every word of every document counts and the model has the same
bounded size for any corpus. The text is read and split once; its features are kept as a checkpoint in the shared
folder and the rounds run over those, in numpy. Per round a task gives one row per feature it holds, these
are added up by Spark, and at most ``BUCKETS`` rows come to the driver. Labels are taken from at most ``LABELLED`` documents (all of
them while there are fewer), chosen by the hash of the document's key, and are joined to the features as a broadcast.

Defined results: documents without text, or with no sentence that has letters, have no row; repeated
documents are rated each for itself; labels of unknown documents and areas are ignored; two labels for
one document both count; a text is read whole; without labels or areas no document is about anything.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ocr_noise import plain

SHARE = 0.2
LEAST = 2
BUCKETS = 1 << 18
WORD_LEAST = 3.0  # features seen less often have no weight
LABELLED = 20_000
ROUNDS = 4
ALPHA = 0.5
BETA = 1.5  # weight of the evidence against the document's mixture
NO_AREA = 4.0  # evidence that any area must exceed
PURE = 0.35  # least share of one area among the documents with a word that counts
BINS = 400  # of the evidence, for the calibration
REACH = 9.25  # the evidence lies within this, see ``logit``

_END = re.compile(r"(?<=[.!?;])[\"'”’»)]*\s+|\n\s*\n")
_WORD = re.compile(r"[^\W\d_]{2,}")


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence of a text; pieces without letters are none."""
    if not text:
        return []
    return [words for part in _END.split(plain(text).casefold()) if (words := _WORD.findall(part))]


def feature(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


@dataclass
class Batch:
    """Sentences of several documents as word numbers."""

    word: np.ndarray  # of each word
    at: np.ndarray  # the sentence of each word
    doc: np.ndarray  # the document of each sentence
    docs: int


    @staticmethod
    def of(words: pa.ListArray, sizes: pa.ListArray) -> Batch:
        """From the stored form: per document its features, and how many of them each sentence has."""
        size = sizes.flatten().to_numpy(zero_copy_only=False)
        many = np.diff(sizes.offsets.to_numpy())
        return Batch(words.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size), np.repeat(np.arange(len(many)), many), len(many))


def encode(text: str | None) -> tuple[list[int], list[int]]:
    """The features of a text, each once a sentence, and their number per sentence."""
    words: list[int] = []
    sizes: list[int] = []
    for sentence in sentences(text):
        found = {feature(w) for w in sentence}
        words += found
        sizes.append(len(found))
    return words, sizes


def sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by group; the rows of a group come one after another, in the order of the groups."""
    out = np.zeros((n, values.shape[1]))
    if len(values):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[first]] = np.add.reduceat(values, first, axis=0)
    return out


@dataclass
class Model:
    areas: list[str]
    weight: np.ndarray  # features x areas; words that are found alike in documents of all areas weigh nothing
    slope: np.ndarray  # of each area's sigmoid
    offset: np.ndarray

    def shares(self, batch: Batch, rounds: int = 3, allowed: np.ndarray | None = None) -> np.ndarray:
        """Shares of each sentence in the areas; the last column is for no area. A document's sentences share a mixture.

        ``allowed``: documents x areas, zero where a label rules an area out.
        """
        n, k = len(batch.doc), len(self.areas)
        raw = np.hstack([BETA * sums(self.weight[batch.word], batch.at, n), np.full((n, 1), NO_AREA)])
        raw = np.exp(raw - raw.max(axis=1, keepdims=True)) if n else raw
        if allowed is not None:
            raw[:, :k] *= allowed[batch.doc]
            raw[:, k] += 1e-12  # never nothing at all
        own = 1 / (k + 1)
        mix = np.full((batch.docs, k + 1), own)
        many = np.bincount(batch.doc, minlength=batch.docs)[:, None]
        for _ in range(rounds):
            out = raw * mix[batch.doc]
            out /= out.sum(axis=1, keepdims=True)
            mix = (sums(out, batch.doc, batch.docs) + 0.3 * own) / (many + 0.3)
            mix[:, -1] = own  # how many sentences are about nothing says nothing about the next one
        return out

    def independent(self, shares: np.ndarray) -> np.ndarray:
        """Calibrated posteriors, one for each area by itself."""
        return 1 / (1 + np.exp(-np.clip(self.slope * logit(shares[:, :-1]) + self.offset, -50, 50)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def complement_weights(counts: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Complement naive Bayes weights of words x areas, against the mean of the areas.

    ``spread``: for each word, how the documents that hold it are spread over the areas.
    """
    size = counts.sum(axis=0)
    rate = counts / np.maximum(size, 1e-9) * size.mean()
    other = rate.sum(axis=1, keepdims=True) - rate + ALPHA
    weight = -np.log(other / other.sum(axis=0))
    weight -= weight.mean(axis=1, keepdims=True)
    k = counts.shape[1]
    area = spread.sum(axis=0)
    even = spread / np.maximum(area, 1e-9) * area.mean() + 2.0 / k
    weight[(even / even.sum(axis=1, keepdims=True)).max(axis=1) < PURE] = 0.0
    weight[counts.sum(axis=1) < WORD_LEAST] = 0.0
    return weight


def calibrate(x: np.ndarray, truth: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a sigmoid for ``n`` sentences each at evidence x with mean truth, by damped Newton steps with a little ridge."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        w = np.maximum(p * (1 - p), 1e-9) * n
        miss = (p - truth) * n
        g = np.array([(miss * x).sum() + 0.1 * (a - 1), miss.sum() + 0.1 * b])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 0.05), b


class Counts:
    """What one round adds up: per feature the sentences' shares, and the spread of its documents."""

    def __init__(self, areas: int, size: int = BUCKETS):
        self.sentence = np.zeros((size, areas))
        self.document = np.zeros((size, areas))

    def add(self, batch: Batch, shares: np.ndarray) -> None:
        if not len(batch.word):
            return
        order = np.argsort(batch.word, kind="stable")
        word, at = batch.word[order], batch.at[order]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        self.sentence[word[first]] += np.add.reduceat(shares[at], first, axis=0)
        total = sums(shares, batch.doc, batch.docs)
        total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-9)
        doc = batch.doc[at]
        once = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])])  # each feature once per document
        word, doc = word[once], doc[once]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        self.document[word[first]] += np.add.reduceat(total[doc], first, axis=0)


def about(model: Model, batch: Batch) -> Iterator[tuple[int, str, int, int, float]]:
    """(document, area, its sentences, all sentences, mean posterior) of the areas that documents are about."""
    if not len(batch.doc):
        return
    p = model.independent(model.shares(batch))
    hits, mass = sums((p >= 0.5).astype(float), batch.doc, batch.docs), sums(p, batch.doc, batch.docs)
    many = np.bincount(batch.doc, minlength=batch.docs)
    for d, i in zip(*np.nonzero((hits >= LEAST) & (hits >= SHARE * many[:, None] - 1e-9))):
        yield int(d), model.areas[i], int(hits[d, i]), int(many[d]), round(float(mass[d, i] / many[d]), 6)


def label_shares(given: list[list[str] | None], place: dict[str, int]) -> np.ndarray:
    """Each document shared evenly among its labels; a row of zeros where there are none."""
    out = np.zeros((len(given), len(place)))
    for d, areas in enumerate(given):
        own = [place[a] for a in areas or [] if a in place]
        if own:
            out[d, own] = 1 / len(own)
    return out


# --- Spark ---------------------------------------------------------------------------------------

FEATURES = "words array<int>, sizes array<int>"


def features(docs: DataFrame, labels: DataFrame | None, key: str = "doc_id", text: str = "text", area: str = "subject_area") -> DataFrame:
    """``key, areas, words, sizes``: every document with sentences, once split; ``areas`` is null where it has no label."""
    from ..session import checkpoint_root

    checkpoint_root(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [encode(t) for t in batch.column(1).to_pylist()]
            keep = np.array([bool(sizes) for _, sizes in rows], bool)
            rows = [r for r in rows if r[1]]
            columns = [pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), *columns], names=["doc_id", "words", "sizes"])

    out = docs.select(F.col(key).cast("long").alias("doc_id"), text).where(F.col(text).isNotNull()).mapInArrow(run, f"doc_id long, {FEATURES}")
    if labels is None:
        return out.withColumn("areas", F.lit(None).cast("array<string>")).checkpoint()
    chosen = labels.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.array_sort(F.collect_set(area)).alias("areas")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    return out.join(F.broadcast(chosen), "doc_id", "left").checkpoint()


def _batch(batch: pa.RecordBatch) -> Batch:
    return Batch.of(batch.column("words"), batch.column("sizes"))


def _round(docs: DataFrame, model: Model, first: bool) -> Counts:
    """One pass over all documents; the first one takes the labels as they are, each sentence shared among them."""
    spark = docs.sparkSession
    k = len(model.areas)
    shared: Broadcast = spark.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(2 * k)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = {a: i for i, a in enumerate(m.areas)}
        total = Counts(k)
        for batch in batches:
            part = _batch(batch)
            given = label_shares(batch.column("areas").to_pylist(), place)
            if first:
                total.add(part, given[part.doc])
            else:
                total.add(part, m.shares(part, allowed=np.where(given.any(axis=1, keepdims=True), given > 0, 1.0))[:, :k])
        rows = np.flatnonzero(total.sentence.any(axis=1) | total.document.any(axis=1))
        for at in range(0, len(rows), 20_000):
            some = rows[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(c[some, i]) for c in (total.sentence, total.document) for i in range(k)]], names=["w", *names])

    df = docs.where("areas IS NOT NULL") if first else docs
    df = df.select("areas", "words", "sizes").mapInArrow(run, "w int, " + ", ".join(f"{c} double" for c in names))
    table = df.groupBy("w").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # at most BUCKETS rows
    out = Counts(k)
    at = table.column("w").to_numpy()
    for i in range(k):
        out.sentence[at, i], out.document[at, i] = table.column(f"c{i}").to_numpy(), table.column(f"c{k + i}").to_numpy()
    shared.unpersist()
    return out


def _calibrated(docs: DataFrame, model: Model) -> None:
    """The sigmoids, from counts of the labelled sentences by evidence: at most areas x BINS rows."""
    k = len(model.areas)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = {a: i for i, a in enumerate(m.areas)}
        n, truth = np.zeros((k, BINS)), np.zeros((k, BINS))
        for batch in batches:
            part, given = _batch(batch), label_shares(batch.column("areas").to_pylist(), place)
            own = given.any(axis=1)[part.doc]
            bins = np.clip(((logit(m.shares(part)[:, :k]) + REACH) / (2 * REACH) * BINS).astype(int), 0, BINS - 1)
            left = m.shares(part, allowed=given > 0)[:, :k]
            for i in range(k):
                n[i] += np.bincount(bins[own, i], minlength=BINS)
                truth[i] += np.bincount(bins[own, i], weights=left[own, i], minlength=BINS)
        i, j = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n[i, j]), pa.array(truth[i, j])], names=["i", "j", "n", "t"])

    rows = docs.where("areas IS NOT NULL").select("areas", "words", "sizes").mapInArrow(run, "i int, j int, n double, t double").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()
    i, j, n, t = (rows.column(c).to_numpy() for c in ("i", "j", "n", "t"))
    for area in range(k):
        own = i == area
        if own.any():
            order = np.argsort(j[own])
            x, m = ((j[own] + 0.5) / BINS * 2 * REACH - REACH)[order], n[own][order]
            model.slope[area], model.offset[area] = calibrate(x, t[own][order] / m, m)
    shared.unpersist()


def fit(docs: DataFrame, areas: list[str]) -> Model:
    """A model from the output of ``features``."""
    k = len(areas)
    model = Model(areas, np.zeros((BUCKETS, k)), np.ones(k), np.zeros(k))
    if not k:
        return model
    for r in range(ROUNDS + 1):
        counted = _round(docs, model, r == 0)
        model.weight = complement_weights(counted.sentence, counted.document)
    _calibrated(docs, model)
    return model


_HELD: dict[str, Model] = {}


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, subject_area, sentences, of_sentences, posterior``: the areas each document is about, from the output of ``features``."""
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, subject_area string, sentences int, of_sentences int, posterior double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _HELD:
            _HELD.clear()
            _HELD[name] = shared.value
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            rows = [(keys[d], *r) for d, *r in about(_HELD[name], _batch(batch))]
            columns = list(zip(*rows)) if rows else [[] for _ in range(5)]
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "subject_area", "sentences", "of_sentences", "posterior"])

    return docs.select("doc_id", "words", "sizes").mapInArrow(run, schema)


def report(spark: SparkSession, folder: str) -> DataFrame:
    from ..session import spread, wide_batches

    wide_batches(spark)
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    areas = sorted(r[0] for r in read("subject_areas").select("subject_area").collect())
    docs = features(spread(read("documents").select("doc_id", "text")), read("subject_labels").where(F.col("subject_area").isin(areas)))
    return classify(docs, fit(docs, areas))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the areas they are about."""
    return report(spark, folder).select("doc_id", "subject_area").distinct()


def composition(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus by area: documents, their sentences about it, and the share of all rated documents."""
    rows = report(spark, folder)
    return rows.groupBy("subject_area").agg(F.countDistinct("doc_id").alias("documents"), F.sum("sentences").alias("sentences"), F.round(F.avg("posterior"), 4).alias("mean_posterior"))


QUERIES = {"p8_found": found, "p8_composition": composition}
SQL: dict[str, str] = {}
