"""Queries of the evidence operators over the derived fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import align as A
from ..operators import evidence as E
from . import fixtures as V


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return A.cost_pairs(V.regions(s, d), V.blocks(s, d))


def iou_pairs(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).where("iou > 0").select("doc", "page", "region", "block", F.round("iou", 6).alias("iou"))


def cost_pairs(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).select("doc", "page", "region", "block", F.round("cost", 6).alias("cost"))


def assign_optimal(s: SparkSession, d: str) -> DataFrame:
    return A.assign_optimal(V.regions(s, d), V.blocks(s, d)).withColumn("cost", F.round("cost", 6))


def assign_greedy(s: SparkSession, d: str) -> DataFrame:
    return A.assign_greedy(V.regions(s, d), V.blocks(s, d)).withColumn("cost", F.round("cost", 6))


def containment(s: SparkSession, d: str) -> DataFrame:
    return A.contained(V.regions(s, d), V.blocks(s, d))


def alignment(s: SparkSession, d: str) -> DataFrame:
    return A.align(V.regions(s, d), V.blocks(s, d))


def unmatched(side: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        return alignment(s, d).where(F.col("status") == f"unmatched_{side}").select("doc", "page", side)

    return query


def gated_unmatched(s: SparkSession, d: str) -> DataFrame:
    """Regions for which no block passes the gate and the limit of cost, and the same for blocks."""
    return A.unfit(V.regions(s, d), V.blocks(s, d))


def matched_regions(s: SparkSession, d: str) -> DataFrame:
    """Regions of the alignment with their block and IoU: one-to-one, then by containment."""
    return A.matched(V.regions(s, d), V.blocks(s, d)).select("doc", "region", "block", "status", "iou")


def lattices(s: SparkSession, d: str) -> DataFrame:
    return E.lattice(E.collect(V.readings(s, d), ["doc", "region"]))


def rated(s: SparkSession, d: str) -> DataFrame:
    """Regions with their block, its IoU and both reading orders (null: unmatched), and their disagreements."""
    joined = lattices(s, d).join(matched_regions(s, d), ["doc", "region"], "left")
    return E.detect(joined.withColumns({"region_order": F.col("region"), "block_order": F.col("block")}))  # the fixture's blocks are numbered in reading order


def _each(df: DataFrame, column: str, into: str) -> DataFrame:
    """Elements of a computed array; for a plain explode a filter on the array would be inferred, which computes it again."""
    return df.select("doc", "region", F.explode_outer(column).alias(into)).where(F.col(into).isNotNull())


def lattice(s: SparkSession, d: str) -> DataFrame:
    p = _each(lattices(s, d), "positions", "p")
    return p.select("doc", "region", F.col("p.position").cast("long").alias("position"), "p.agreement", "p.is_critical", F.array_join(F.transform("p.words", lambda w: F.coalesce(w.word, F.lit("-"))), "|").alias("words"), "p.conflict")


def overall(s: SparkSession, d: str) -> DataFrame:
    return lattices(s, d).select("doc", "region", "overall")


def pair_scripts(s: SparkSession, d: str) -> DataFrame:
    """Steps of the edit scripts between all readings of a region, by kind."""
    p = E.scripts(E.collect(V.readings(s, d), ["doc", "region"]))
    n = lambda x, op: F.size(F.filter(x.steps, lambda step: step.op == op)).cast("long").alias(op.lower())
    counted = F.transform("scripts", lambda x: F.struct(x.a.cast("long").alias("a"), x.b.cast("long").alias("b"), *[n(x, op) for op in ("MATCH", "SUBSTITUTION", "DELETION", "INSERTION")]))
    return p.select("doc", "region", F.inline(counted))


def detect_all(s: SparkSession, d: str) -> DataFrame:
    return _each(rated(s, d), "disagreements", "r").groupBy("doc", "region", "r.type", "r.severity").agg(F.count(F.lit(1)).alias("n"))


def disagreement(kind: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        return _each(rated(s, d), "disagreements", "r").where(F.col("r.type") == kind).select("doc", "region", "r.severity", "r.span")

    return query


def proposals(strategy: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        p = E.propose(rated(s, d), V.SELECT, strategy)
        return p.select("doc", "region", "proposed_text", "auto_proposable", "requires_review", F.array_join("indicators", ",").alias("indicators"))

    return query


def majority_vote(s: SparkSession, d: str) -> DataFrame:
    p = _each(lattices(s, d), "positions", "p")
    return p.select("doc", "region", F.col("p.position").cast("long").alias("position"), E.majority(F.col("p.words"), V.SELECT).alias("word"))


def fusion_summary(s: SparkSession, d: str) -> DataFrame:
    return E.fusion_summary(E.propose(rated(s, d), V.SELECT).withColumn("matched", F.col("block").isNotNull()), ["doc"])


def region_evidence(s: SparkSession, d: str) -> DataFrame:
    """Region with its proposal, disagreements and alignment, each aggregated before it is joined."""
    p = E.propose(rated(s, d), V.SELECT).select("doc", "region", "proposed_text", F.array_join("reasons", ",").alias("reasons"), "block", "status", "iou")
    return V.regions(s, d).select("doc", "page", "region", "text").join(p, ["doc", "region"], "left")


def candidate_pairs(s: SparkSession, d: str) -> DataFrame:
    h = V.readings(s, d)
    a, b = (h.select("doc", "region", *[F.col(c).alias(f"{c}_{n}") for c in ("ord", "text")]) for n in "ab")
    return a.join(b, ["doc", "region"]).where("ord_a < ord_b").select("doc", "region", F.col("ord_a").cast("long"), F.col("ord_b").cast("long"), F.round(X.edit_ratio(F.col("text_a"), F.col("text_b")), 6).alias("ratio"))


def recovery_outcomes(s: SparkSession, d: str) -> DataFrame:
    p = E.collect(V.readings(s, d), ["doc", "region"])
    texts = F.transform("hyps", lambda h: h.text)
    got = F.when(F.col("region") % 4 == 0, "item").when(F.col("region") % 4 == 1, F.get(texts, F.lit(0))).when(F.col("region") % 4 == 2, "").otherwise("something else that is about as long")
    return p.select("doc", "region", E.recovery_outcome(got, texts).alias("outcome"))


def recovery_plan(s: SparkSession, d: str) -> DataFrame:
    r = V.regions(s, d)
    v = E.recovery_variants(F.when(F.col("l_partkey") % 3 != 0, 4 * F.col("l_discount")), (F.col("l_suppkey") % 7 - 3).cast("double"))
    return r.select("doc", "region", F.posexplode(v).alias("at", "variant")).where("at < 2").select("doc", "region", F.col("at").cast("long").alias("at"), "variant")


def bbox_from_polygon(s: SparkSession, d: str) -> DataFrame:
    r = V.regions(s, d)
    px = lambda c, n: F.col("box")[c] * 10 + n
    poly = F.when(F.col("region") % 6 == 0, F.array(F.array(px("x", 0), px("y", 0)))).otherwise(F.array(F.array(px("x", -30), px("y", 0)), F.array(px("x", 333), px("y", 0)), F.array(px("x", 333), px("y", 77)), F.array(px("x", -30), px("y", 77))))
    return r.select("doc", "region", G.from_polygon(poly, F.lit(1000), F.lit(900)).alias("b")).select("doc", "region", F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("b.w").alias("w"), F.col("b.h").alias("h"))


def bbox_valid(s: SparkSession, d: str) -> DataFrame:
    return V.blocks(s, d).select("doc", "page", "block", G.is_valid(F.col("box")).alias("valid"))


def crop(s: SparkSession, d: str) -> DataFrame:
    return V.regions(s, d).select("doc", "region", G.crop_pixels(F.col("box"), F.lit(1654), F.lit(2339)).alias("c")).select("doc", "region", *[F.col(f"c.{c}").cast("long").alias(c) for c in ("left", "top", "width", "height")])


_COST = V.COST
_SAFE = V.DIS + (
    ", flag AS (SELECT o.doc, o.region, o.overall, r.n, r.a, r.b, r.c, coalesce(bool_or(d.severity='CRITICAL'),false) AS critical, coalesce(bool_or(d.type='NUMERIC_CONFLICT'),false) AS num, coalesce(bool_or(d.type='DATE_CONFLICT'),false) AS dt, coalesce(bool_or(d.type='UNIT_CONFLICT'),false) AS un, "
    "coalesce(bool_or(d.type='INSUFFICIENT_EVIDENCE'),false) AS few, count(d.type) AS nd FROM over o JOIN reading r USING (doc, region) LEFT JOIN dis d USING (doc, region) GROUP BY ALL)"
)
# the first reading has every word but those that another adds, and a vote that is not of the others' family
_MAJ = "maj AS (SELECT doc, region, i, word FROM lat)"
_IND = "concat_ws(',','UNCALIBRATED',CASE WHEN num THEN 'CRITICAL_NUMERIC' END,CASE WHEN dt THEN 'CRITICAL_DATE' END,CASE WHEN un THEN 'CRITICAL_UNIT' END,'CONTAINS_CRITICAL_TOKENS',CASE WHEN overall='FULL_DISAGREEMENT' THEN 'FULL_DISAGREEMENT' END,CASE WHEN overall='MINORITY_DISAGREEMENT' THEN 'MINORITY_DISAGREEMENT' END)"


def _propose_sql(text: str, auto: str) -> str:
    joined = f", {_MAJ}, voted AS (SELECT doc, region, string_agg(word,' ' ORDER BY i) AS said FROM maj GROUP BY doc, region)"
    return f"WITH RECURSIVE {_SAFE}{joined}, p AS (SELECT f.*, {text} AS proposed_text, {auto} AS auto_proposable FROM flag f JOIN voted v USING (doc, region)) SELECT doc, region, proposed_text, auto_proposable, NOT auto_proposable OR critical OR overall='FULL_DISAGREEMENT' OR few AS requires_review, {_IND} AS indicators FROM p"


_AUTO = "(NOT critical AND overall<>'FULL_DISAGREEMENT')"
_AWARE_TEXT = "CASE WHEN overall IN ('FULL_AGREEMENT','SINGLE_MODEL_ONLY') THEN coalesce(b,a) WHEN overall='MINORITY_DISAGREEMENT' THEN said WHEN critical OR overall='FULL_DISAGREEMENT' THEN coalesce(b,a) END"
_AWARE_AUTO = f"CASE WHEN overall IN ('FULL_AGREEMENT','SINGLE_MODEL_ONLY') THEN NOT critical WHEN overall='MINORITY_DISAGREEMENT' THEN {_AUTO} ELSE false END"
_AWARE = _propose_sql(_AWARE_TEXT, _AWARE_AUTO)
_KINDS = ["INSUFFICIENT_EVIDENCE", "MODEL_UNAVAILABLE", "LOW_RAW_CONFIDENCE", "MODEL_DISAGREEMENT", "NUMERIC_CONFLICT", "DATE_CONFLICT", "UNIT_CONFLICT", "MISSING_TEXT", "UNSUPPORTED_COMPLETION_SUSPECTED", "GEOMETRY_MISMATCH", "READING_ORDER_CONFLICT"]
_WHY = f"why AS (WITH o AS (SELECT DISTINCT doc, region, type, list_position({_KINDS},type) AS place FROM dis) SELECT doc, region, string_agg(type,',' ORDER BY place) AS reasons FROM o GROUP BY doc, region)"

QUERIES = {
    "iou_pairs": iou_pairs, "cost_pairs": cost_pairs, "assign_one_to_one": assign_optimal, "assign_greedy": assign_greedy, "containment_join": containment, "alignment": alignment, "unmatched_gated": gated_unmatched,
    "unmatched_regions": unmatched("region"), "unmatched_blocks": unmatched("block"),
    "lattice_agreement": lattice, "overall_agreement": overall, "pair_scripts": pair_scripts, "detect_all": detect_all, "majority_vote": majority_vote, **{kind.lower(): disagreement(kind) for kind in _KINDS},
    "propose_best": proposals("best_individual"), "propose_rover": proposals("unweighted_rover"), "propose_evidence_aware": proposals("evidence_aware"), "fusion_summary": fusion_summary, "region_evidence": region_evidence,
    "candidate_pairs": candidate_pairs, "recovery_outcome": recovery_outcomes, "recovery_plan": recovery_plan, "bbox_from_polygon": bbox_from_polygon, "bbox_valid": bbox_valid, "crop_pixels": crop,
}
SQL = {
    "iou_pairs": f"WITH {_COST} SELECT doc, page, region, block, round(iou,6) AS iou FROM pc WHERE iou>0",
    "cost_pairs": f"WITH {_COST} SELECT doc, page, region, block, round(cost,6) AS cost FROM pc",
    "assign_one_to_one": f"WITH RECURSIVE {V.ALIGN} SELECT doc, page, region, block, round(cost,6) AS cost FROM chosen",
    "assign_greedy": f"WITH RECURSIVE {V.GREEDY} SELECT doc, page, region, block, round(cost,6) AS cost FROM gr WHERE cost<=0.85",
    "alignment": f"WITH RECURSIVE {V.ALIGN} SELECT doc, page, region, block, status, iou, confidence FROM al UNION ALL SELECT doc, page, region, NULL, 'unmatched_region', NULL, 0.0 FROM reg WHERE (doc, region) NOT IN (SELECT doc, region FROM al) UNION ALL SELECT doc, page, NULL, block, 'unmatched_block', NULL, 0.0 FROM blk WHERE (doc, block) NOT IN (SELECT doc, block FROM al)",
    "unmatched_regions": f"WITH RECURSIVE {V.ALIGN} SELECT doc, page, region FROM reg WHERE (doc, region) NOT IN (SELECT doc, region FROM al)",
    "unmatched_blocks": f"WITH RECURSIVE {V.ALIGN} SELECT doc, page, block FROM blk WHERE (doc, block) NOT IN (SELECT doc, block FROM al)",
    "containment_join": f"WITH {_COST} SELECT doc, page, region, min(block) AS block FROM pc WHERE inside GROUP BY doc, page, region",
    "unmatched_gated": f"WITH {_COST} SELECT doc, page, region AS id, 'region' AS side FROM reg r WHERE NOT EXISTS (SELECT 1 FROM pc WHERE pc.doc=r.doc AND pc.region=r.region AND pc.cost<=0.85) UNION ALL SELECT doc, page, block, 'block' FROM blk b WHERE NOT EXISTS (SELECT 1 FROM pc WHERE pc.doc=b.doc AND pc.block=b.block AND pc.cost<=0.85)",
    "lattice_agreement": f"WITH {V.POS} SELECT doc, region, CAST(i-1 AS BIGINT) AS position, agreement, is_critical, words, conflict FROM lat",
    "overall_agreement": f"WITH {V.POS} SELECT doc, region, overall FROM over",
    "detect_all": f"WITH RECURSIVE {V.DIS} SELECT doc, region, type, severity, count(*) AS n FROM dis GROUP BY ALL",
    **{kind.lower(): f"WITH RECURSIVE {V.DIS} SELECT doc, region, severity, span FROM dis WHERE type='{kind}'" for kind in _KINDS},
    "majority_vote": f"WITH {V.POS}, {_MAJ} SELECT doc, region, CAST(i-1 AS BIGINT) AS position, word FROM maj",
    "propose_best": _propose_sql("coalesce(b,a)", _AUTO),
    "propose_rover": _propose_sql("said", _AUTO),
    "propose_evidence_aware": _AWARE,
    "fusion_summary": _AWARE.replace("SELECT doc, region, proposed_text, auto_proposable,", "SELECT doc, region, nd, proposed_text, auto_proposable,").replace(" SELECT doc, region, nd,", ", aware AS (SELECT doc, region, nd,")
    + ") SELECT a.doc, count(*) AS regions, count(al.region) AS matched, count(*) FILTER (WHERE nd>0) AS with_disagreement, count(*) FILTER (WHERE auto_proposable) AS auto_proposable, count(*) FILTER (WHERE requires_review) AS requires_review, count(*) FILTER (WHERE requires_review OR regexp_matches(indicators,'CRITICAL_(NUMERIC|DATE|UNIT)')) AS recovery_eligible FROM aware a LEFT JOIN al USING (doc, region) GROUP BY a.doc",
    "candidate_pairs": f"WITH {V.READING}, e AS (SELECT doc, region, 0 AS ord_a, 1 AS ord_b, a AS x, b AS y FROM reading WHERE n>1 UNION ALL SELECT doc, region, 0, 2, a, c FROM reading WHERE n>2 UNION ALL SELECT doc, region, 1, 2, b, c FROM reading WHERE n>2) SELECT doc, region, CAST(ord_a AS BIGINT) AS ord_a, CAST(ord_b AS BIGINT) AS ord_b, CASE WHEN x=y THEN 0.0 ELSE round(levenshtein(x,y)*1.0/greatest(length(x),length(y),1),6) END AS ratio FROM e",
    "recovery_outcome": f"WITH {V.POS}, e AS (SELECT doc, region, lower(a) AS g, list_distinct(list_filter([lower(a),lower(b),lower(c)], lambda v: v IS NOT NULL AND v<>'')) AS t, list_min(list_transform(list_filter([a,b,c], lambda v: v IS NOT NULL AND v<>''), lambda v: length(v))) AS sh FROM reading) "
    "SELECT doc, region, CASE WHEN region%4=2 THEN 'NEUTRAL' WHEN region%4=1 THEN CASE WHEN len(t)>1 THEN 'IMPROVED' ELSE 'NEUTRAL' END WHEN region%4=0 AND 4<0.5*sh THEN 'REGRESSED' WHEN region%4=3 AND 35<0.5*sh THEN 'REGRESSED' ELSE 'NEUTRAL' END AS outcome FROM e",
    "recovery_plan": f"WITH {V.REG}, v AS (SELECT doc, region, list_filter(['PADDED', CASE WHEN l_partkey%3=0 OR 4*l_discount<0.4 THEN 'CLAHE' END, CASE WHEN abs(l_suppkey%7-3)>=1.5 THEN 'DESKEWED' END], lambda x: x IS NOT NULL)[1:2] AS l FROM reg) SELECT doc, region, CAST(unnest(range(len(l))) AS BIGINT) AS at, unnest(l) AS variant FROM v",
    "bbox_from_polygon": f"WITH {V.REG}, q AS (SELECT doc, region, greatest(0,x*10-30) AS x1, y*10 AS y1, least(1000,x*10+333) AS x2, least(900,y*10+77) AS y2 FROM reg), e AS (SELECT doc, region, round(x1/1000*100,2) AS x, round(y1/900*100,2) AS y, round((greatest(x1+1,x2)-x1)/1000*100,2) AS w, round((greatest(y1+1,y2)-y1)/900*100,2) AS h FROM q) "
    "SELECT doc, region, CASE WHEN region%6=0 THEN 5 ELSE x END AS x, CASE WHEN region%6=0 THEN 5 ELSE y END AS y, CASE WHEN region%6=0 THEN 90 WHEN x+w>100 THEN greatest(0.1,round(100-x,2)) ELSE w END AS w, CASE WHEN region%6=0 THEN 10 WHEN y+h>100 THEN greatest(0.1,round(100-y,2)) ELSE h END AS h FROM e",
    "bbox_valid": f"WITH {V.BLK} SELECT doc, page, block, x BETWEEN 0 AND 100 AND y BETWEEN 0 AND 100 AND w>0 AND w<=100 AND h>0 AND h<=100 AND x+w<=100.001 AND y+h<=100.001 AS valid FROM blk",
    "crop_pixels": f"WITH {V.REG}, q AS (SELECT doc, region, greatest(1,CAST(trunc(w/100*1654) AS BIGINT)) AS width, greatest(1,CAST(trunc(h/100*2339) AS BIGINT)) AS height, CAST(trunc(x/100*1654) AS BIGINT) AS l, CAST(trunc(y/100*2339) AS BIGINT) AS t FROM reg) SELECT doc, region, greatest(0,least(l,1654-width)) AS \"left\", greatest(0,least(t,2339-height)) AS top, width, height FROM q",
    "region_evidence": _AWARE.replace(" SELECT doc, region, proposed_text, auto_proposable,", ", aware AS (SELECT doc, region, proposed_text, auto_proposable,") + f"), {_WHY} SELECT r.doc, r.page, r.region, r.text, a.proposed_text, coalesce(w.reasons,'') AS reasons, al.block, al.status, al.iou FROM reg r LEFT JOIN aware a USING (doc, region) LEFT JOIN al USING (doc, region) LEFT JOIN why w USING (doc, region)",
}
