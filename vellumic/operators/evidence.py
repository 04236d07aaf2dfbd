"""Competing readings of a region: word lattice, disagreements, proposal, recovery.

A region is one row with ``hyps``, its readings in order: array<struct<ord, model, text, conf>>. One shuffle
brings them together; from then on a region never leaves its row. All rules are expressions over that
array; the word alignment of a region's readings is the only Arrow function, and regions whose
readings agree send it nothing. Ties always go by ``ord``.

Defined results: a region without readings has no position, INSUFFICIENT_EVIDENCE and no proposal; a null text
is an empty one; of two readings by one model the later counts; columns of the input stay beside the results.
"""

from __future__ import annotations

import warnings
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DETECT, RECOVER, DetectConfig, RecoverConfig, SelectConfig
from ..functions import text as X
from ..functions.edit import against_first, pairwise_scripts
from ..functions.text import let

#: Agreement of readings, worst first.
AGREEMENT = ["FULL_DISAGREEMENT", "MISSING_TEXT", "EXTRA_TEXT", "MINORITY_DISAGREEMENT", "SINGLE_MODEL_ONLY", "FULL_AGREEMENT"]
POSITION = "struct<position:int,words:array<struct<ord:int,model:string,word:string>>,agreement:string,is_critical:boolean,conflict:string>"
STRATEGIES = ("best_individual", "unweighted_rover", "evidence_aware", "evidence_aware_with_recovery")


def collect(hyps: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, ord, model, text, conf) as one row per region; of two readings by one model the later ord counts."""
    said = hyps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("int").alias("ord"), "model", "text", "conf"))).alias("hyps"))
    later = lambda h, i: F.exists(F.slice("hyps", i + 2, F.size("hyps")), lambda x: x.model.eqNullSafe(h.model))
    again = F.size(F.array_distinct(F.transform("hyps", lambda h: h.model))) < F.size("hyps")
    return said.withColumn("hyps", F.when(again, F.filter("hyps", lambda h, i: ~later(h, i))).otherwise(F.col("hyps")))


def _agreement(words: Column, n: Column) -> Column:
    """Class of one position from its words (null: the model has none there)."""

    def of(said: Column) -> Column:
        gap = F.size(said) < F.size(words)

        def by(kinds: Column) -> Column:
            votes = F.aggregate(kinds, F.lit(0), lambda acc, k: F.greatest(acc, F.size(F.filter(said, lambda w: w == k))))
            return (
                F.when(F.size(kinds) == 1, F.when(gap, "MISSING_TEXT").otherwise("FULL_AGREEMENT"))
                .when((F.size(kinds) == 2) & (n > 2), F.when(votes >= 2, "MINORITY_DISAGREEMENT").otherwise("FULL_DISAGREEMENT"))
                .when(F.size(kinds) > 1, "FULL_DISAGREEMENT").otherwise("FULL_AGREEMENT")
            )

        return let(F.array_distinct(said), by)

    return let(F.filter(F.transform(words, lambda w: w.word), lambda w: w.isNotNull()), of)


def lattice(regions: DataFrame) -> DataFrame:
    """Adds ``positions`` (the first reading's words, then words that others add) and ``overall``."""
    keep = regions.columns
    df = regions.withColumn("_said", F.transform("hyps", lambda h: F.coalesce(X.normalize(h.text), F.lit(""))))
    df = df.withColumn("_others", against_first(F.when(F.size(F.array_distinct("_said")) > 1, F.col("_said"))))
    df = df.withColumn("_own", F.coalesce(F.filter(F.split(F.get("_said", F.lit(0)), " "), lambda t: t != ""), F.array().cast("array<string>")))
    n, others, first = F.size("hyps"), F.slice("hyps", 2, F.size("hyps")), F.get("hyps", F.lit(0))
    same = F.col("_others").isNull()

    def words_at(own: Column, i: Column) -> Column:
        """What each reading has at one place of the first; one that is equal to it as a whole is null here."""
        said = F.transform(others, lambda h, k: F.struct(h.ord.alias("ord"), h.model.alias("model"), let(F.get("_others", k), lambda o: F.when(o.isNull(), own).otherwise(F.get(o.words, i))).alias("word")))
        return F.concat(F.array(F.struct(first["ord"].alias("ord"), first["model"].alias("model"), own.alias("word"))), said)

    def rated(p: Column) -> Column:
        level = F.when(n < 2, "SINGLE_MODEL_ONLY").when(same, "FULL_AGREEMENT").otherwise(_agreement(p.words, n))
        return let(level, lambda a: F.struct(p.position.alias("position"), p.words.alias("words"), a.alias("agreement"), X.is_critical(p.own).alias("is_critical"), F.when(a.isin("MINORITY_DISAGREEMENT", "FULL_DISAGREEMENT"), _side_by_side(p.words)).alias("conflict")))

    none = F.array().cast("array<string>")
    added = F.flatten(F.transform(others, lambda h, k: F.transform(F.coalesce(F.get("_others", k).added, none), lambda w: F.struct(h.ord.alias("ord"), h.model.alias("model"), w.alias("word")))))
    extra = F.transform(
        added, lambda w, i: F.struct((F.size("_own") + i).cast("int").alias("position"), F.array(w).alias("words"), F.lit("EXTRA_TEXT").alias("agreement"), X.is_critical(w.word).alias("is_critical"), F.concat(F.lit("inserted: "), w.word).alias("conflict"))
    )
    placed = F.transform("_own", lambda own, i: F.struct(i.cast("int").alias("position"), own.alias("own"), words_at(own, i).alias("words")))
    df = df.withColumn("positions", F.concat(F.transform(placed, rated), F.when(same, F.array().cast(f"array<{POSITION}>")).otherwise(extra)).cast(f"array<{POSITION}>"))
    levels = F.transform("positions", lambda p: p.agreement)
    worst = F.lit("FULL_AGREEMENT")
    for level in reversed(AGREEMENT[:-1]):
        worst = F.when(F.array_contains(levels, level), level).otherwise(worst)
    return df.withColumn("overall", F.when(n < 2, "SINGLE_MODEL_ONLY").when(same, "FULL_AGREEMENT").otherwise(worst)).select(*keep, "positions", "overall")


def _side_by_side(words: Column) -> Column:
    """The different words of a position in alphabetical order."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda w: w.word), lambda w: w.isNotNull()))), " vs ")


def scripts(regions: DataFrame) -> DataFrame:
    """Adds ``scripts``: the word edit scripts of all pairs of readings, earlier against later."""
    said = regions.withColumn("_said", F.transform("hyps", lambda h: F.coalesce(X.normalize(h.text), F.lit(""))))
    return said.withColumn("scripts", pairwise_scripts(F.when(F.size("_said") > 1, F.col("_said")))).drop("_said")


def _record(kind: str, severity: str | Column, span: Column | None = None) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(kind).alias("type"), severity.alias("severity"), (F.lit(None).cast("string") if span is None else span.cast("string")).alias("span"))


def conflict(said: Column) -> tuple[Column, Column]:
    """Whether values differ where at least one says something, and the first three side by side, repeats included."""
    differ = (F.size(F.array_distinct(said)) > 1) & F.exists(said, lambda v: v != "")
    return differ, F.array_join(F.transform(F.slice(said, 1, 3), lambda v: F.when(v == "", "(none)").otherwise(v)), " vs ")


def detect(regions: DataFrame, cfg: DetectConfig = DETECT) -> DataFrame:
    """Adds ``disagreements`` in the order of the rules. Needs ``positions``; ``iou`` and ``orders`` are optional."""
    h, spoken = F.col("hyps"), F.col("_spoken")
    given = regions.columns
    regions = regions.withColumn("_spoken", F.filter(h, lambda c: ~X.is_blank(c.text)))
    regions = regions.withColumn("_texts", F.array_distinct(F.transform("_spoken", lambda c: c.text)))
    # equal texts have equal numbers, dates and units: only regions with several texts are looked at
    several = F.size("_texts") > 1
    rules = (("NUMERIC_CONFLICT", X.digits), ("DATE_CONFLICT", X.dates), ("UNIT_CONFLICT", X.units))
    spoken_text = lambda pick: F.transform("_spoken", lambda c: pick(c.text))
    regions = regions.withColumns({f"_{kind}": F.when(several, spoken_text(pick)).otherwise(F.array().cast("array<string>")) for kind, pick in rules})
    regions = regions.withColumns({"_apart": F.filter("positions", lambda p: ~p.agreement.isin("FULL_AGREEMENT", "SINGLE_MODEL_ONLY"))})
    none = F.array().cast("array<struct<type:string,severity:string,span:string>>")
    low = F.transform(F.filter(h, lambda c: c.conf < cfg.low_confidence), lambda c: _record("LOW_RAW_CONFIDENCE", "MEDIUM", c.model))
    mute = F.transform(F.filter(h, lambda c: X.is_blank(c.text)), lambda c: _record("MODEL_UNAVAILABLE", "HIGH", c.model))
    apart = F.col("_apart")
    gaps = F.filter(apart, lambda p: p.agreement == "MISSING_TEXT")

    def when(test: Column, record: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.array(record)).otherwise(none)

    parts = [mute, low, when(F.size(apart) > 0, _record("MODEL_DISAGREEMENT", F.when(F.exists(apart, lambda p: p.is_critical), "CRITICAL").otherwise("HIGH")))]
    for kind, _ in rules:
        differ, span = conflict(F.col(f"_{kind}"))
        parts.append(when(differ, _record(kind, "CRITICAL", span)))
    lost = F.filter(F.flatten(F.transform(gaps, lambda p: F.transform(p.words, lambda w: w.word))), lambda w: w.isNotNull())  # a word for each model that has it
    parts.append(when(F.size(gaps) > 0, _record("MISSING_TEXT", "HIGH", F.array_join(F.slice(lost, 1, 5), " "))))
    longer = F.flatten(
        F.transform(spoken, lambda a: F.transform(F.filter(spoken, lambda b: (b.ord > a.ord) & (F.length(b.text) / F.greatest(F.length(a.text), F.lit(1)) > cfg.completion_ratio)), lambda b: _record("UNSUPPORTED_COMPLETION_SUSPECTED", "HIGH", F.concat_ws(" > ", b.model, a.model))))
    )
    parts.append(longer)
    if "iou" in regions.columns:
        parts.append(when(F.col("iou") < cfg.least_iou, _record("GEOMETRY_MISMATCH", "MEDIUM")))
    if {"region_order", "block_order"} <= set(regions.columns):
        both = (F.coalesce("region_order", F.lit(0)) != 0) & (F.coalesce("block_order", F.lit(0)) != 0)
        parts.append(when(both & (F.abs(F.col("region_order") - F.col("block_order")) > cfg.order_gap), _record("READING_ORDER_CONFLICT", "LOW")))
    few = F.concat(F.array(_record("INSUFFICIENT_EVIDENCE", "MEDIUM")), low)
    return regions.withColumn("disagreements", F.when(F.size(h) < 2, few).otherwise(F.concat(*parts))).select(*given, "disagreements")


def majority(words: Column, cfg: SelectConfig) -> Column:
    """The word with most votes, ties to the earlier voter; one that only the family says yields to another with an independent vote."""

    def ranked(said: Column) -> Column:
        kinds = F.array_distinct(F.transform(said, lambda w: w.word))

        def rate(k: Column) -> Column:
            return let(
                F.filter(said, lambda w: w.word == k),
                lambda own: F.struct((-F.size(own)).alias("votes"), F.array_min(F.transform(own, lambda w: w.ord)).alias("first"), F.forall(own, lambda w: w.model.isin(*cfg.family)).alias("family"), k.alias("word")),
            )

        return let(F.array_sort(F.transform(kinds, rate)), lambda r: F.coalesce(F.when(F.get(r, F.lit(0)).family, F.get(F.filter(r, lambda x: ~x.family), F.lit(0)).word), F.get(r, F.lit(0)).word))

    return let(F.filter(words, lambda w: w.word.isNotNull()), ranked)


def propose(regions: DataFrame, cfg: SelectConfig, strategy: str = "evidence_aware") -> DataFrame:
    """Adds proposed_text, auto_proposable, requires_review, indicators and reasons. Never hides a critical conflict.

    An unknown strategy counts as ``evidence_aware``, with a warning.
    """
    if strategy not in STRATEGIES:
        warnings.warn(f"unknown strategy {strategy!r}: evidence_aware is used", stacklevel=2)
    h, d, level = F.col("hyps"), F.col("disagreements"), F.col("overall")
    given = regions.columns
    agreed = lambda p: F.get(F.filter(F.transform(p.words, lambda w: w.word), lambda w: w.isNotNull()), F.lit(0))
    quick = lambda p: F.when(p.agreement.isin("FULL_AGREEMENT", "SINGLE_MODEL_ONLY"), agreed(p)).otherwise(majority(p.words, cfg))
    regions = regions.withColumn("_voted", F.array_join(F.filter(F.transform("positions", quick), lambda w: w.isNotNull()), " "))
    critical = F.exists(d, lambda r: r.type.isin("NUMERIC_CONFLICT", "DATE_CONFLICT", "UNIT_CONFLICT") | (r.severity == "CRITICAL"))
    split, few = level == "FULL_DISAGREEMENT", F.exists(d, lambda r: r.type == "INSUFFICIENT_EVIDENCE")
    spoken = lambda model: F.filter(h, lambda c: (c.model == model) & ~X.is_blank(c.text))
    best = F.coalesce(*[F.get(spoken(m), F.lit(0))["text"] for m in cfg.reliability], F.get(h, F.lit(0))["text"])
    safe = ~critical & ~split
    if strategy == "best_individual":
        said, auto = best, safe
    elif strategy == "unweighted_rover":
        said, auto = F.when(F.size("positions") > 0, F.col("_voted")).otherwise(best), safe
    else:  # evidence_aware, evidence_aware_with_recovery, and anything unknown
        whole = level.isin("FULL_AGREEMENT", "SINGLE_MODEL_ONLY")
        said = F.when(whole, best).when(level == "MINORITY_DISAGREEMENT", F.col("_voted")).when(critical | split, best)
        auto = F.when(whole, ~critical).when(level == "MINORITY_DISAGREEMENT", safe).otherwise(False)
    models = F.array_distinct(F.transform(h, lambda c: c.model))
    has = lambda kind: F.exists(d, lambda r: r.type == kind)
    codes = [
        F.lit("UNCALIBRATED"), F.when(has("NUMERIC_CONFLICT"), "CRITICAL_NUMERIC"), F.when(has("DATE_CONFLICT"), "CRITICAL_DATE"), F.when(has("UNIT_CONFLICT"), "CRITICAL_UNIT"),
        F.when(F.exists("positions", lambda p: p.is_critical), "CONTAINS_CRITICAL_TOKENS"), F.when(split, "FULL_DISAGREEMENT"), F.when(level == "MINORITY_DISAGREEMENT", "MINORITY_DISAGREEMENT"),
        F.when((F.size(models) > 1) & (F.size(F.array_except(models, F.array(*map(F.lit, cfg.family)))) == 0), "CORRELATED_MODELS_ONLY"),
    ]
    none = F.size(h) == 0
    df = regions.withColumns({"_auto": F.coalesce(F.when(none, False).otherwise(auto), F.lit(False)), "_text": F.when(~none, said)})
    return df.withColumns(
        {
            "proposed_text": F.col("_text"), "auto_proposable": F.col("_auto"), "requires_review": ~F.col("_auto") | critical | split | few, "indicators": F.array_compact(F.array(*codes)),
            "reasons": F.array_distinct(F.transform(d, lambda r: r.type)),
        }
    ).select(*given, "proposed_text", "auto_proposable", "requires_review", "indicators", "reasons")


def recovery_eligible(requires_review: Column, indicators: Column, confidence: Column, attempts: Column, provider: Column, cfg: RecoverConfig = RECOVER) -> Column:
    urgent = F.exists(indicators, lambda i: i.isin("CRITICAL_NUMERIC", "CRITICAL_DATE", "CRITICAL_UNIT"))
    return F.coalesce(provider & (attempts < cfg.most_variants) & (requires_review | urgent | F.coalesce(confidence < cfg.low_confidence, F.lit(False))), F.lit(False))


def recovery_variants(confidence: Column, angle: Column, cfg: RecoverConfig = RECOVER) -> Column:
    """Which versions of a crop are worth another reading."""
    dim = confidence.isNull() | (confidence < cfg.low_confidence)
    return F.array_compact(F.array(F.lit("PADDED"), F.when(dim, "CLAHE"), F.when(F.abs(angle) >= cfg.least_angle, "DESKEWED")))


def recovery_outcome(recovered: Column, existing: Column, cfg: RecoverConfig = RECOVER) -> Column:
    """What another reading was worth next to the texts there are."""
    plain = lambda t: F.regexp_replace(F.lower(t), r"^\s+|\s+$", "")
    said = F.transform(F.filter(existing, lambda t: ~X.is_blank(t)), plain)
    mine = plain(recovered)
    shortest = F.array_min(F.transform(said, F.length))
    return (
        F.when(X.is_blank(recovered) | (F.coalesce(F.size(said), F.lit(0)) <= 0), "NEUTRAL").when(F.array_contains(said, mine), F.when(F.size(F.array_distinct(said)) > 1, "IMPROVED").otherwise("NEUTRAL"))
        .when(F.length(mine) < cfg.shrink * shortest, "REGRESSED").otherwise("NEUTRAL")
    )


def fusion_summary(regions: DataFrame, by: list[str]) -> DataFrame:
    """Counters of a run. Needs the columns of ``propose`` and ``matched``."""
    return regions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("regions"), F.count_if("matched").alias("matched"), F.count_if(F.size("disagreements") > 0).alias("with_disagreement"), F.count_if("auto_proposable").alias("auto_proposable"),
        F.count_if("requires_review").alias("requires_review"), F.count_if(recovery_eligible(F.col("requires_review"), F.col("indicators"), F.lit(None).cast("double"), F.lit(0), F.lit(True))).alias("recovery_eligible"),
    )
