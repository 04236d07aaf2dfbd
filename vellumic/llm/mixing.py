"""Sources combined to target weights (problem 7).

Sizes are tokens of a public tokenizer. Of a source that is to give N tokens and has A, every document is
taken floor(N / A) times (complete epochs, at most ``max_repeats``); the rest is a weighted sample without
replacement after Efraimidis and Spirakis: each document draws an exponential key, scaled by its
quality weight, and documents are taken in the order of their keys while the running sum of their tokens stays within
the rest. The draw is a hash of seed and key, so a run can be repeated.

Scale: a source may hold a third of all rows, so no source is ever sorted in one task. Keys fall into ordered buckets,
``BUCKETS`` to an octave, so that whatever the weights a bucket holds at most about 1 / (3.9 BUCKETS) of a source; the tokens
per (source, bucket) are summed with map-side partial sums, the bucket in which the rest is used up is found from these
sums, and only the documents of that one bucket are sorted. Token counts are made once and cut from their
lineage by a checkpoint in the shared folder. Targets are broadcast while there are at most ``TARGETS``, else joined.

A target out of reach gives what it has and shows its shortfall; the others keep their budgets, so their actual shares are
higher. ``even_total`` is the largest total at which all targets with documents keep their shares; ``plan`` takes it as ``total``.

Defined results: documents without text have no tokens and are not taken; a null source, or one without a
target, gets no share and is reported with target null; a target without documents, or beyond its cap, gets
what there is and its shortfall is reported; the crossing document is taken if that brings the source
nearer to its budget; ties of keys go by the document's key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root, spread, wide_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BUCKETS = 1024
SEED = 17
TARGETS = 10_000


def token_counts(df: DataFrame, text: str, into: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """The table without its text, with the number of tokens (0 for null)."""
    keep = [c for c in df.columns if c != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text] + [f"`{into}` long"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for batch in batches:
            texts = batch.column(text).to_pylist()
            sizes = [len(e.ids) for e in t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(sizes, pa.int64())], names=[*keep, into])

    return df.mapInArrow(run, schema)


def quality(text: Column) -> Column:
    """A weight in [0.1, 1]: the share of a text's characters that are letters or blanks."""
    clean = F.length(F.regexp_replace(text, r"[^\p{L}\s]", ""))
    return F.greatest(F.lit(0.1), F.coalesce(clean / F.nullif(F.length(text), F.lit(0)), F.lit(0.1)))


def exponential_key(key: Column, weight: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight for a u in (0, 1) that depends on seed and key only; smaller keys come first."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def even_total(goal: DataFrame) -> float | None:
    """The largest total of which every target with documents can have its share within its cap."""
    reach = goal.where("available > 0 AND target_share > 0").agg(F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")))
    return reach.first()[0]


def plan(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per target: tokens there are, budget, complete epochs and the rest for the fractional part."""
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count_if(F.col("n_tokens") > 0).alias("documents"))
    whole = float(total if total is not None else have.agg(F.sum("available")).first()[0] or 0)
    rows = targets.join(have, "source", "full_outer").withColumns({"available": F.coalesce("available", F.lit(0)), "documents": F.coalesce("documents", F.lit(0))})
    rows = rows.withColumn("total", F.lit(whole))
    rows = rows.withColumn("budget", F.least(F.floor(F.col("target_share") * F.col("total")), F.col("available") * F.col("max_repeats")))
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0)
    return rows.withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("int")).withColumn("rest", F.coalesce(F.col("budget") - F.col("epochs") * F.col("available"), F.lit(0)))


def bucket_of(key: Column) -> Column:
    """Buckets in the order of keys: equal steps of their logarithm."""
    return F.floor(F.log2(F.greatest(key, F.lit(1e-300))) * BUCKETS).cast("int")


def mix(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED, most: int = TARGETS) -> tuple[DataFrame, DataFrame]:
    """(documents with how often each is taken, the plan). ``sized``: doc_id, source, n_tokens, quality."""
    small = F.broadcast if targets.limit(most + 1).count() <= most else lambda df: df
    goal = plan(sized, targets, total)
    docs = sized.where(F.col("n_tokens") > 0).join(small(goal.where("budget > 0").select("source", "epochs", "rest")), "source")
    docs = docs.withColumn("key", exponential_key(F.col("doc_id"), F.col("quality"), seed)).withColumn("bucket", bucket_of(F.col("key")))
    heap = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    heap = heap.withColumn("before", F.coalesce(before, F.lit(0)))
    # the last bucket that begins within the rest: all before it are taken whole
    edge = heap.where(F.col("before") < F.col("rest")).groupBy("source").agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("e")).select("source", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before"))
    docs = docs.join(small(edge), "source", "left")
    inner = docs.where(F.col("bucket") == F.col("edge"))
    running = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    at_edge = inner.withColumn("cum", F.col("before") + running).withColumn("extra", (F.col("cum") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    others = docs.where(F.col("edge").isNull() | (F.col("bucket") != F.col("edge"))).withColumn("extra", F.coalesce((F.col("bucket") < F.col("edge")).cast("int"), F.lit(0)))
    columns = ["doc_id", "source", "n_tokens", (F.col("epochs") + F.col("extra")).cast("int").alias("copies")]
    taken = others.select(*columns).unionByName(at_edge.select(*columns)).where("copies > 0")
    return taken, goal


def shares(taken: DataFrame, goal: DataFrame) -> DataFrame:
    """Target and actual share of each source, and what was out of reach."""
    used = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    used = used.withColumnRenamed("source", "used_source")
    rows = goal.join(used, F.col("source").eqNullSafe(F.col("used_source")), "left")
    tokens = F.coalesce(F.col("tokens"), F.lit(0))
    all_tokens = F.lit(taken.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0])
    even = F.lit(even_total(goal)).cast("double")
    return rows.select(
        "source", "target_share", "max_repeats", "documents", F.col("available").alias("available_tokens"), tokens.alias("tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.round(tokens / F.nullif(all_tokens, F.lit(0)), 6).alias("actual_share"), F.round(F.greatest(F.col("target_share") * F.col("total") - tokens, F.lit(0.0)) / F.nullif(F.col("total"), F.lit(0)), 6).alias("shortfall_share"),
        F.when(F.col("available") > 0, F.floor(F.col("target_share") * even)).alias("even_tokens"),
    )


def sized_documents(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    wide_batches(spark)
    checkpoint_root(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", F.round(quality(F.col("text")), 4).alias("quality"), "text")
    return token_counts(spread(docs), "text", tokenizer=tokenizer).checkpoint()


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mix(sized_documents(spark, folder), spark.read.parquet(f"{folder}/mix_targets.parquet"))


def mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture and how often each is in it."""
    return _mixture(spark, folder)[0]


def report(spark: SparkSession, folder: str) -> DataFrame:
    return shares(*_mixture(spark, folder))


QUERIES = {"p7_mixture": mixture, "p7_shares": report}
SQL: dict[str, str] = {}
