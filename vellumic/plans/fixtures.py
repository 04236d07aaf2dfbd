"""Evidence views derived from the order lines: regions, layout blocks and competing readings, in Spark and as SQL.

An order is a document, its lines are regions on two pages in turn; the line's values make up the text.
Readings differ by rules on the keys: another quantity, another unit, another date, capitals, a word lost, added or split, nothing
at all, or one or two readings only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SelectConfig
from ..functions.geometry import box
from ..sources.tables import table

#: The fixture's readers: the second is the best, it shares its make with the third.
MODELS = ("reader-a", "reader-b", "reader-c")
SELECT = SelectConfig(reliability=("reader-b", "reader-a", "reader-c"), family=("reader-b", "reader-c"))
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)).cast("long"))


def regions(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit("item "), F.col("l_partkey"), F.lit(" weighs "), F.col("l_quantity").cast("long"), F.lit(" kg on "), F.date_format("l_shipdate", "dd/MM/yyyy"))
    return lines(spark, folder).select(
        F.col("l_orderkey").alias("doc"), ((F.col("rn") - 1) % 2).cast("int").alias("page"), F.col("rn").alias("region"), box(F.col("l_partkey") * 7 % 60, (F.col("rn") - 1) * 7 % 90, 20 + F.col("l_suppkey") % 20, F.lit(5)).alias("box"),
        text.alias("text"), F.round(1 - F.col("l_discount"), 4).alias("conf"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("qty"), "l_discount",
    )


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    r = regions(spark, folder)
    far = F.col("l_suppkey") % 5 == 0
    large = F.col("l_suppkey") % 5 == 1
    b = F.col("box")
    placed = (
        F.when(far, box(F.lit(96), (b["y"] + 47) % 90, F.lit(3), b["h"])).when(large, box(b["x"], b["y"], b["w"], F.lit(20)))
        .otherwise(box(b["x"] + 1, b["y"] + 0.5, b["w"], b["h"]))
    )
    return r.select("doc", "page", F.col("region").alias("block"), placed.alias("box"), "text", F.col("region").cast("int").alias("reading_order"))


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """doc, region, ord, model, text, conf."""
    r = regions(spark, folder)
    text, part, supp = F.col("text"), F.col("l_partkey"), F.col("l_suppkey")
    swap = lambda a, b: F.replace(text, F.lit(a), F.lit(b))
    b = (
        F.when(part % 5 == 0, F.replace(text, F.concat(F.lit(" weighs "), F.col("qty")), F.concat(F.lit(" weighs "), F.col("qty") + 1))).when(part % 19 == 0, F.upper(text))
        .when(part % 7 == 0, swap(" weighs ", " weighs about ")).when(part % 11 == 0, swap(" on ", " ")).when(part % 13 == 0, swap(" kg ", " k g ")).otherwise(text)
    )
    c = (
        F.when(supp % 11 == 0, "").when(supp % 3 == 0, swap(" kg ", " lb ")).when(supp % 7 == 0, F.concat(F.substring_index(text, " on ", 1), F.lit(" on 31/12/1999")))
        .when(supp % 13 == 0, swap(" weighs ", " ")).when(supp % 17 == 0, F.concat(text, F.lit(" in all as was said"))).otherwise(text)
    )
    confs = (F.col("conf"), F.round(1 - 2 * F.col("l_discount"), 4), F.round(4 * F.col("l_discount"), 4))
    said = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(MODELS[i]).alias("model"), t.alias("text"), confs[i].alias("conf")) for i, t in enumerate((text, b, c))])
    many = F.when(part % 17 == 0, 1).when(part % 29 == 0, 2).otherwise(3)
    return r.select("doc", "region", F.explode(F.slice(said, F.lit(1), many)).alias("h")).select("doc", "region", "h.*")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Ground truth and a reading of each region (nothing, other words, one lost, one added, other digits) and a style."""
    r = regions(spark, folder)
    text, part = F.col("text"), F.col("l_partkey")
    read = (
        F.when(part % 23 == 0, "").when(part % 5 == 0, F.replace(text, F.lit("weighs"), F.lit("wcigh"))).when(part % 7 == 0, F.replace(text, F.lit(" on "), F.lit(" ")))
        .when(part % 11 == 0, F.concat(text, F.lit(" net"))).when(F.col("l_suppkey") % 3 == 0, F.replace(text, F.lit("1"), F.lit("7"))).otherwise(text)
    )
    return r.select("doc", "region", F.concat(F.lit("style-"), part % 4).alias("style_category"), text.alias("ground_truth"), read.alias("prediction"))


LI = f"li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS rn FROM lineitem)"
REG = (
    LI + ", reg AS (SELECT l_orderkey AS doc, CAST((rn-1)%2 AS INTEGER) AS page, CAST(rn AS BIGINT) AS region, CAST(l_partkey*7%60 AS DOUBLE) AS x, CAST((rn-1)*7%90 AS DOUBLE) AS y, CAST(20+l_suppkey%20 AS DOUBLE) AS w, CAST(5 AS DOUBLE) AS h, "
    "'item '||l_partkey||' weighs '||CAST(l_quantity AS BIGINT)||' kg on '||strftime(l_shipdate,'%d/%m/%Y') AS text, round(1-l_discount,4) AS conf, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS qty, l_discount FROM li)"
)
BLK = (
    REG + ", blk AS (SELECT doc, page, region AS block, CASE WHEN l_suppkey%5=0 THEN 96 WHEN l_suppkey%5=1 THEN x ELSE x+1 END AS x, CASE WHEN l_suppkey%5=0 THEN (y+47)%90 WHEN l_suppkey%5=1 THEN y ELSE y+0.5 END AS y, "
    "CASE WHEN l_suppkey%5=0 THEN 3 ELSE w END AS w, CASE WHEN l_suppkey%5=1 THEN 20 ELSE h END AS h, text, CAST(region AS INTEGER) AS reading_order FROM reg)"
)
# one row per region: how many readings it has, and their texts
READING = (
    REG + ", reading AS MATERIALIZED (SELECT doc, page, region, n, l_partkey, l_suppkey, qty, text AS a, conf AS ca, CASE WHEN n>1 THEN b END AS b, round(1-2*l_discount,4) AS cb, CASE WHEN n>2 THEN c END AS c, round(4*l_discount,4) AS cc FROM (SELECT *, "
    "CASE WHEN l_partkey%17=0 THEN 1 WHEN l_partkey%29=0 THEN 2 ELSE 3 END AS n, "
    "CASE WHEN l_partkey%5=0 THEN replace(text,' weighs '||qty,' weighs '||(qty+1)) WHEN l_partkey%19=0 THEN upper(text) WHEN l_partkey%7=0 THEN replace(text,' weighs ',' weighs about ') WHEN l_partkey%11=0 THEN replace(text,' on ',' ') WHEN l_partkey%13=0 THEN replace(text,' kg ',' k g ') ELSE text END AS b, "
    "CASE WHEN l_suppkey%11=0 THEN '' WHEN l_suppkey%3=0 THEN replace(text,' kg ',' lb ') WHEN l_suppkey%7=0 THEN split_part(text,' on ',1)||' on 31/12/1999' WHEN l_suppkey%13=0 THEN replace(text,' weighs ',' ') WHEN l_suppkey%17=0 THEN text||' in all as was said' ELSE text END AS c FROM reg))"
)
HYP = (
    READING + ", hyp AS (SELECT doc, region, n, 0 AS ord, 'reader-a' AS model, a AS text, ca AS conf FROM reading UNION ALL SELECT doc, region, n, 1, 'reader-b', b, cb FROM reading WHERE n>1 UNION ALL SELECT doc, region, n, 2, 'reader-c', c, cc FROM reading WHERE n>2)"
)
# the lattice: what each rule of the fixture leaves at the seven places of the first reading, and what it adds
POS = (
    HYP + ", l7 AS (SELECT *, string_split(lower(a),' ') AS l FROM reading), "
    "said AS (SELECT doc, region, n, l AS la, CASE WHEN n<2 THEN NULL WHEN l_partkey%5=0 THEN [l[1],l[2],l[3],CAST(qty+1 AS VARCHAR),l[5],l[6],l[7]] WHEN l_partkey%19=0 OR l_partkey%7=0 THEN l WHEN l_partkey%11=0 THEN [l[1],l[2],l[3],l[4],l[5],NULL,l[7]] WHEN l_partkey%13=0 THEN [l[1],l[2],l[3],l[4],'g',l[6],l[7]] ELSE l END AS lb, "
    "CASE WHEN n<3 THEN NULL WHEN l_suppkey%11=0 THEN [NULL,NULL,NULL,NULL,NULL,NULL,NULL]::VARCHAR[] WHEN l_suppkey%3=0 THEN [l[1],l[2],l[3],l[4],'lb',l[6],l[7]] WHEN l_suppkey%7=0 THEN [l[1],l[2],l[3],l[4],l[5],l[6],'31/12/1999'] WHEN l_suppkey%13=0 THEN [l[1],l[2],NULL,l[4],l[5],l[6],l[7]] ELSE l END AS lc, "
    "list_concat(CASE WHEN n<2 OR l_partkey%5=0 OR l_partkey%19=0 THEN []::VARCHAR[] WHEN l_partkey%7=0 THEN ['about'] WHEN l_partkey%11=0 THEN [] WHEN l_partkey%13=0 THEN ['k'] ELSE [] END, "
    "CASE WHEN n<3 OR l_suppkey%11=0 OR l_suppkey%3=0 OR l_suppkey%7=0 OR l_suppkey%13=0 THEN []::VARCHAR[] WHEN l_suppkey%17=0 THEN ['in','all','as','was','said'] ELSE [] END) AS extra FROM l7), "
    "pos AS (SELECT doc, region, n, i, la[i] AS wa, lb[i] AS wb, lc[i] AS wc, list_filter([la[i],lb[i],lc[i]], lambda v: v IS NOT NULL) AS there FROM said, range(1,8) t(i)), "
    "anchor AS (SELECT *, CASE WHEN n<2 THEN 'SINGLE_MODEL_ONLY' WHEN len(list_distinct(there))=1 AND len(there)<n THEN 'MISSING_TEXT' WHEN len(list_distinct(there))=1 THEN 'FULL_AGREEMENT' WHEN len(list_distinct(there))=2 AND len(there)=3 THEN 'MINORITY_DISAGREEMENT' ELSE 'FULL_DISAGREEMENT' END AS agreement FROM pos), "
    "lat AS (SELECT doc, region, n, i, agreement, there, wa AS word, wa||CASE WHEN n>1 THEN '|'||coalesce(wb,'-') ELSE '' END||CASE WHEN n>2 THEN '|'||coalesce(wc,'-') ELSE '' END AS words, CASE WHEN agreement IN ('MINORITY_DISAGREEMENT','FULL_DISAGREEMENT') THEN array_to_string(list_sort(list_distinct(there)),' vs ') END AS conflict, "
    r"regexp_matches(wa, '\b\d+[\d.,/-]*\b') AS is_critical FROM anchor UNION ALL "
    "SELECT doc, region, n, 7+unnest(range(1,len(extra)+1)), 'EXTRA_TEXT', [], unnest(extra), unnest(extra), 'inserted: '||unnest(extra), false FROM said), "
    "over AS (SELECT doc, region, CASE WHEN bool_or(agreement='FULL_DISAGREEMENT') THEN 'FULL_DISAGREEMENT' WHEN bool_or(agreement='MISSING_TEXT') THEN 'MISSING_TEXT' WHEN bool_or(agreement='EXTRA_TEXT') THEN 'EXTRA_TEXT' WHEN bool_or(agreement='MINORITY_DISAGREEMENT') THEN 'MINORITY_DISAGREEMENT' WHEN bool_or(agreement='SINGLE_MODEL_ONLY') THEN 'SINGLE_MODEL_ONLY' ELSE 'FULL_AGREEMENT' END AS overall FROM lat GROUP BY doc, region)"
)
# all pairs of a page, and the cheapest of all one-to-one matchings by trying each (a page has four regions at most)
COST = (
    BLK.replace(", blk AS (", ", blk AS MATERIALIZED (") + ", pr AS (SELECT r.doc, r.page, r.region, b.block, greatest(0, least(r.x+r.w,b.x+b.w)-greatest(r.x,b.x)) AS ix, greatest(0, least(r.y+r.h,b.y+b.h)-greatest(r.y,b.y)) AS iy, r.w AS rw, r.h AS rh, b.w AS bw, b.h AS bh, "
    "abs(r.y+r.h/2-b.y-b.h/2)/100 AS dv, least(1.0, b.reading_order/10.0) AS od, levenshtein(lower(r.text),lower(b.text))*1.0/greatest(length(r.text),length(b.text),1) AS tx, "
    "(r.x+r.w/2) BETWEEN b.x AND b.x+b.w AND (r.y+r.h/2) BETWEEN b.y AND b.y+b.h AS inside FROM reg r JOIN blk b ON r.doc=b.doc AND r.page=b.page), "
    "pi AS (SELECT *, ix*iy/(rw*rh+bw*bh-ix*iy) AS iou FROM pr), pc AS MATERIALIZED (SELECT *, CASE WHEN iou<0.02 AND ix/least(rw,bw)<0.1 THEN 999.0 ELSE 0.5*(1-iou)+0.3*dv+0.1*od+0.1*tx END AS cost FROM pi)"
)
_RANKED = COST + ", rk AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY doc, page ORDER BY region) AS ri, dense_rank() OVER (PARTITION BY doc, page ORDER BY block) AS bi FROM pc)"
ALIGN = (
    _RANKED + ", perm AS (SELECT doc, page, CAST(1 AS BIGINT) AS k, CAST(1<<bi AS BIGINT) AS used, cost AS total, [block] AS picks FROM rk WHERE ri=1 UNION ALL "
    "SELECT p.doc, p.page, p.k+1, CAST(p.used | (1<<r.bi) AS BIGINT), p.total+r.cost, list_append(p.picks, r.block) FROM perm p JOIN rk r ON r.doc=p.doc AND r.page=p.page AND r.ri=p.k+1 WHERE ((p.used>>r.bi)&1)=0), "
    "best AS (SELECT doc, page, arg_min(picks, total) AS picks FROM perm WHERE k=len(picks) AND (doc, page, k) IN (SELECT doc, page, max(ri) FROM rk GROUP BY doc, page) GROUP BY doc, page), "
    "chosen AS (SELECT r.* FROM rk r JOIN best b USING (doc, page) WHERE b.picks[r.ri]=r.block AND r.cost<=0.85), "
    "many AS (SELECT doc, page, region, arg_min(block, block) AS block, arg_min(iou, block) AS iou FROM pc WHERE inside AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.doc=pc.doc AND c.region=pc.region) AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.doc=pc.doc AND c.block=pc.block) GROUP BY doc, page, region), "
    "al AS MATERIALIZED (SELECT doc, page, region, block, 'one_to_one' AS status, round(iou,4) AS iou, round(greatest(0,least(1,1-cost)),4) AS confidence FROM chosen UNION ALL SELECT doc, page, region, block, 'one_to_many', round(iou,4), 0.6 FROM many)"
)
GREEDY = (
    _RANKED + ", gr AS (SELECT doc, page, CAST(1<<ri AS BIGINT) AS ur, CAST(1<<bi AS BIGINT) AS ub, region, block, cost FROM rk QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY cost, ri, bi)=1 UNION ALL "
    "SELECT g.doc, g.page, CAST(g.ur | (1<<r.ri) AS BIGINT), CAST(g.ub | (1<<r.bi) AS BIGINT), r.region, r.block, r.cost FROM gr g JOIN rk r ON r.doc=g.doc AND r.page=g.page WHERE ((g.ur>>r.ri)&1)=0 AND ((g.ub>>r.bi)&1)=0 QUALIFY row_number() OVER (PARTITION BY g.doc, g.page ORDER BY r.cost, r.ri, r.bi)=1)"
)
# one row per disagreement
DIS = (
    POS + ", " + ALIGN.removeprefix(REG + ", ") + r", dg AS (SELECT doc, region, ord, model, text, conf, n, regexp_replace(text,'[^0-9]','','g') AS dig, array_to_string(regexp_extract_all(text,'\b(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2})\b',1),' ') AS dat, "
    r"array_to_string(regexp_extract_all(text,'(?i)\b\d+\s?(?:mm|cm|m|km|mg|g|kg|ml|l|lb|oz|ft|in|psi|kpa|bar|deg|%)\b'),' ') AS uni FROM hyp), "
    "dis AS (SELECT doc, region, 'INSUFFICIENT_EVIDENCE' AS type, 'MEDIUM' AS severity, NULL::VARCHAR AS span FROM reading WHERE n<2 UNION ALL SELECT doc, region, 'LOW_RAW_CONFIDENCE','MEDIUM', model FROM dg WHERE conf<0.3 UNION ALL SELECT doc, region, 'MODEL_UNAVAILABLE','HIGH', model FROM dg WHERE n>1 AND trim(text)='' UNION ALL "
    "SELECT doc, region, 'MODEL_DISAGREEMENT', CASE WHEN bool_or(is_critical) THEN 'CRITICAL' ELSE 'HIGH' END, NULL FROM lat WHERE agreement NOT IN ('FULL_AGREEMENT','SINGLE_MODEL_ONLY') GROUP BY doc, region UNION ALL "
    + " UNION ALL ".join(f"SELECT doc, region, '{t}','CRITICAL', string_agg(CASE WHEN {c}='' THEN '(none)' ELSE {c} END, ' vs ' ORDER BY ord) FROM dg WHERE n>1 AND trim(text)<>'' GROUP BY doc, region HAVING count(DISTINCT {c})>1" for t, c in (("NUMERIC_CONFLICT", "dig"), ("DATE_CONFLICT", "dat"), ("UNIT_CONFLICT", "uni")))
    + " UNION ALL SELECT doc, region, 'MISSING_TEXT','HIGH', array_to_string(flatten(list(there ORDER BY i))[1:5],' ') FROM lat WHERE agreement='MISSING_TEXT' GROUP BY doc, region UNION ALL "
    "SELECT a.doc, a.region, 'UNSUPPORTED_COMPLETION_SUSPECTED','HIGH', b.model||' > '||a.model FROM dg a JOIN dg b ON a.doc=b.doc AND a.region=b.region AND a.ord<b.ord WHERE trim(a.text)<>'' AND trim(b.text)<>'' AND length(b.text)*1.0/greatest(length(a.text),1)>1.2 UNION ALL "
    "SELECT doc, region, 'GEOMETRY_MISMATCH','MEDIUM', NULL FROM al JOIN reading USING (doc, region) WHERE n>1 AND iou<0.05 UNION ALL SELECT doc, region, 'READING_ORDER_CONFLICT','LOW', NULL FROM al JOIN reading USING (doc, region) WHERE n>1 AND abs(region-block)>2)"
)
