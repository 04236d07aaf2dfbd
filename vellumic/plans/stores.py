"""Queries of the store, export and report operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as P
from ..operators import store
from ..sources import files
from ..sources.tables import table
from . import fixtures as V


def recovery_budget(s: SparkSession, d: str) -> DataFrame:
    """Attempts are a document's regions; equal quantities are equal variants, each took some of the time."""
    a = V.regions(s, d).select("doc", "region", (F.col("qty") % 4).alias("sha"), (F.col("qty") * 2500).alias("ms"))
    return store.budgeted(a, ["doc"], ["region"]).select("doc", "region", "status")


def transcripts(s: SparkSession, d: str) -> DataFrame:
    r = V.regions(s, d).withColumn("status", F.when(F.col("qty") % 4 == 0, "pending").otherwise("accepted"))
    return files.export_transcripts(r, ["doc"], "region", "text", "status").select("doc", "unresolved", F.md5("transcript").alias("transcript"))


def lab_reports(s: SparkSession, d: str) -> DataFrame:
    r = V.regions(s, d)
    head = F.col("region") % 3 == 1
    cells = r.select("doc", F.col("region").alias("ord"), F.when(head, F.concat(F.lit("part "), F.col("region"))).otherwise("weight").alias("name"), F.when(~head, F.col("qty").cast("string")).alias("value"), F.when(~head & (F.col("doc") % 2 == 0), "kg").alias("unit"), F.lit("").alias("range"))
    report = P.lab_report(P.lab_rows(cells, ["doc"], "ord"), ["doc"])
    return report.select("doc", F.size("results").cast("long").alias("results"), F.array_join(F.transform("results", lambda x: F.concat_ws("=", x.section, x.value.low.cast("int"))), ",").alias("values"), F.array_join("warnings", ",").alias("warnings"))


def run_attempts(s: SparkSession, d: str) -> DataFrame:
    """Proposals per document with the stable ids of the attempts that were run for them."""
    a = recovery_budget(s, d).where("status = 'RUN'").withColumn("attempt_id", store.stable_id("att", F.col("doc"), F.col("region")))
    p = V.regions(s, d).select("doc").distinct().withColumn("attempt_ids", F.array(F.lit("att-0")))
    return store.link_attempts(p, a, ["doc"]).select("doc", F.size("attempt_ids").cast("long").alias("n"), F.array_join("attempt_ids", ",").alias("ids"))


def alias_defaults(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents", "doc_id", "source", "lang", "page_count")
    t = files.default_each_other(t, [("source", "lang")])
    size = files.page_size(F.when(F.col("doc_id") % 2 == 0, "application/pdf").otherwise("image/png"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 600), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 800))
    return t.select("doc_id", "source", "lang", size["width"].cast("long").alias("width"), size["height"].cast("long").alias("height"))


_BUDGET = (
    V.REG + ", att AS (SELECT doc, region, qty%4 AS sha, qty*2500 AS ms, row_number() OVER (PARTITION BY doc, qty%4 ORDER BY region)>1 AS copy FROM reg), "
    "bu AS (SELECT doc, region, ms, copy, sum(CASE WHEN copy THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY region) AS n, coalesce(sum(CASE WHEN copy THEN 0 ELSE ms END) OVER (PARTITION BY doc ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS spent FROM att), "
    "st AS (SELECT doc, region, CASE WHEN copy THEN 'DUPLICATE' WHEN n>2 OR spent>=120000 THEN 'BUDGET_EXHAUSTED' WHEN ms>120000 THEN 'TIMEOUT' ELSE 'RUN' END AS status FROM bu)"
)
QUERIES = {"recovery_budget": recovery_budget, "transcript_export": transcripts, "lab_report": lab_reports, "recovery_attempts_linked": run_attempts, "alias_defaults": alias_defaults}
SQL = {
    "recovery_budget": f"WITH {_BUDGET} SELECT doc, region, status FROM st",
    "recovery_attempts_linked": f"WITH {_BUDGET}, r AS (SELECT doc, 'att-'||substring(sha256(doc||'|'||region),1,8) AS id FROM st WHERE status='RUN') SELECT d.doc, 1+count(id) AS n, concat_ws(',','att-0',string_agg(id,',' ORDER BY id)) AS ids FROM (SELECT DISTINCT doc FROM reg) d LEFT JOIN r ON r.doc=d.doc GROUP BY d.doc",
    "transcript_export": f"WITH {V.REG}, g AS (SELECT doc, count(*) FILTER (WHERE qty%4=0) AS unresolved, string_agg(text, chr(10) ORDER BY region) AS t FROM reg GROUP BY doc) SELECT doc, unresolved, md5(CASE WHEN unresolved>0 THEN 'DRAFT - '||unresolved||' unresolved'||chr(10) ELSE '' END||t) AS transcript FROM g",
    "lab_report": f"WITH {V.REG} SELECT doc, count(*) AS results, string_agg('part '||(region-(region-1)%3)||'='||qty, ',' ORDER BY region) AS \"values\", CASE WHEN doc%2=0 THEN '' ELSE 'NO_UNITS_OR_RANGES' END AS warnings FROM reg WHERE region%3<>1 GROUP BY doc",
    "alias_defaults": "WITH t AS (SELECT doc_id, coalesce(source,lang) AS source, coalesce(lang,source) AS lang, CASE WHEN doc_id%3<>0 THEN doc_id%600 END AS w, CASE WHEN doc_id%5<>0 THEN doc_id%800 END AS h FROM documents) SELECT doc_id, source, lang, CAST(CASE WHEN doc_id%2=0 THEN coalesce(trunc(w*2.77),1000) ELSE coalesce(w,1000) END AS BIGINT) AS width, CAST(CASE WHEN doc_id%2=0 THEN coalesce(trunc(h*2.77),1414) ELSE coalesce(h,1000) END AS BIGINT) AS height FROM t",
}
