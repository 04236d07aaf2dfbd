"""Queries of the filter, window, metric, review, ingest, extraction and job operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import JOBS
from ..functions import extract as P
from ..functions import text as X
from ..operators import evidence as E
from ..operators import ingest, metrics, review
from ..operators.align import latest_by
from ..sources.tables import table
from ..streaming import jobs
from . import fixtures as V

ACTIVE = list(JOBS.active)


def docs_filter_page(s: SparkSession, d: str) -> DataFrame:
    """Documents of one source whose title matches a pattern, newest first: the second page of 20."""
    t = table(s, d, "documents", "doc_id", "title", "source", "captured_at").where((F.col("source") == "clinic_scans") & F.col("title").rlike("(?i)sheet"))
    return t.orderBy(F.col("captured_at").desc(), "doc_id").offset(20).limit(20).select("doc_id", "title")


def docs_client_filter(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents", "doc_id", "title", "source", "lang")
    hits = t.where(F.lower(F.concat_ws(" ", "title", "source")).contains("verso") & (F.lower("lang") == "en"))
    return hits.orderBy(F.col("title").desc_nulls_last(), "doc_id").select("doc_id", "title", F.coalesce("source", F.lit("unknown")).alias("source"))


def evaluations_filter(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "sample_evaluations", "eval_id", "benchmark_id", "provider", "confidence")
    return t.where(F.lower("benchmark_id").contains("inkreader") & (F.col("confidence").isNull() | (F.col("confidence") < 0.30))).select("eval_id", "benchmark_id").distinct()


def latest_per_key(s: SparkSession, d: str) -> DataFrame:
    """The newest run of each document."""
    r = table(s, d, "payload").select("parsing_run.document_id", "parsing_run.id", "parsing_run.created_at")
    return r.groupBy("document_id").agg(F.max(F.struct("created_at", "id")).alias("m")).select("document_id", F.col("m.id").alias("id"))


def topk_per_key(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return latest_by(o, ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


def region_ordinals(s: SparkSession, d: str) -> DataFrame:
    r = V.regions(s, d)
    n = F.row_number().over(Window.partitionBy("doc").orderBy("page", "region"))
    return r.select("doc", "region", F.format_string("reg-p%d-%03d", F.col("page"), n).alias("region_id"))


def set_operations(s: SparkSession, d: str) -> DataFrame:
    """Pages of either side, and how they differ."""
    r, b = V.regions(s, d), V.blocks(s, d).where(F.col("box")["w"] != 3)  # no margin blocks: some pages have only regions
    pages = r.select("doc", "page").union(b.select("doc", "page")).distinct()
    only = r.select("doc", "page").distinct().exceptAll(b.select("doc", "page").distinct())
    return pages.join(only.withColumn("only_regions", F.lit(True)), ["doc", "page"], "left").select("doc", "page", F.coalesce("only_regions", F.lit(False)).alias("only_regions"))


def metric_cer_by_category(s: SparkSession, d: str) -> DataFrame:
    return metrics.summary(metrics.scored(V.predictions(s, d), False), ["style_category"], False)


def metric_wer(s: SparkSession, d: str) -> DataFrame:
    return metrics.summary(metrics.scored(V.predictions(s, d)), ["style_category"])


def metric_evaluations(s: SparkSession, d: str) -> DataFrame:
    """Error rates of the recorded evaluations by model and style, each evaluation once."""
    t = table(s, d, "sample_evaluations", "eval_id", "model_identifier", "style_category", "ground_truth", "prediction").dropDuplicates(["eval_id"])
    return metrics.summary(metrics.scored(t), ["model_identifier", "style_category"])


def metric_latency(s: SparkSession, d: str) -> DataFrame:
    return metrics.latency(table(s, d, "events", "event_type", "value"), "value", ["event_type"])


def dataset_hash(s: SparkSession, d: str) -> DataFrame:
    return metrics.dataset_hash(table(s, d, "benchmark_samples"), "sample_id", F.col("sha256"))


def dataset_tree(s: SparkSession, d: str) -> DataFrame:
    return metrics.dataset_tree(table(s, d, "lineitem"), "l_orderkey", F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), 256))


def style_category(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "benchmark_samples", "sample_id", "ground_truth")
    return t.select("sample_id", X.style_category(F.col("ground_truth"), F.regexp_extract("sample_id", r"(\d+)$", 1).cast("int")).alias("style"))


def normalize_tokens(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    return t.select("doc_id", F.md5(X.normalize(F.col("text"))).alias("normalized"), F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def critical_tokens(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    w = t.select("doc_id", F.explode(X.tokens(F.col("text"))).alias("w")).where(X.is_critical(F.col("w")))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("w").alias("n_distinct"))


def merge_preserve_review(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    old = o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 == 0, "accepted").otherwise("pending").alias("status"), F.concat(F.lit("old-"), "o_orderpriority").alias("decision"))
    new = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k"), F.lit("pending").alias("status"), F.concat(F.lit("new-"), "o_orderpriority").alias("decision"))
    return review.merge_keep_review(old, new, ["k"], ["status", "decision"])


def decision_status(s: SparkSession, d: str) -> DataFrame:
    r = V.regions(s, d)
    there = F.array(F.lit("a"), F.concat(F.lit("q"), F.col("qty") % 3))
    status = review.decision_status(F.col("qty") % 7 == 0, F.when(F.col("qty") % 2 == 0, F.col("text")).when(F.col("qty") % 3 == 0, F.lit("  ")))
    return r.select("doc", "region", status.alias("status"), F.array_join(review.add_candidate(there, F.concat(F.lit("q"), F.col("region") % 3)), ",").alias("alternatives"))


def review_queue(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "prescription_vl_result").select(F.col("result_id").alias("doc"), F.explode("pages").alias("p")).select("doc", F.explode("p.blocks").alias("b")).where("b IS NOT NULL")
    items = v.select("doc", F.col("b.block_id").alias("block"), F.col("b.confidence").alias("confidence")).distinct()
    done = items.where(F.col("block").endswith("-1")).select("doc", "block", F.lit(True).alias("corrected")).distinct()
    return review.queue_counts(items.join(done, ["doc", "block"], "left").withColumn("corrected", F.coalesce("corrected", F.lit(False))), ["doc"])


def unresolved_regions(s: SparkSession, d: str) -> DataFrame:
    r = V.regions(s, d).withColumn("status", F.when(F.col("qty") % 4 == 0, "pending").otherwise("accepted"))
    return review.unresolved(r, ["doc"])


def revision_fold(s: SparkSession, d: str) -> DataFrame:
    """Per user, each event is an edit; it expects the revision that its value points to."""
    e = table(s, d, "events").withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    return review.revision_fold(e.select(F.col("user_id").alias("doc"), "seq", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("seq") - 1).cast("long").alias("expected")))


def _job_events(s: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("queued", "submitted", "running", "completed", "failed")))
    return table(s, d, "events").select(F.col("user_id").alias("job"), "ts", F.col("event_id").alias("seq"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("state"))


def job_state_fold(s: SparkSession, d: str) -> DataFrame:
    return jobs.current(_job_events(s, d)).select("job", "state", F.date_format("last_pulse", "yyyy-MM-dd HH:mm:ss").alias("last_pulse"), "failures")


def active_jobs(s: SparkSession, d: str) -> DataFrame:
    return jobs.current(_job_events(s, d)).where(F.col("state").isin(ACTIVE)).select("job", "state")


def stale_jobs(s: SparkSession, d: str) -> DataFrame:
    e = _job_events(s, d)
    now = e.agg(F.max("ts").alias("now"))  # one row
    return jobs.expire(jobs.current(e).crossJoin(F.broadcast(now)), F.col("now")).select("job", "state")


def first_submissions(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", "event_type", "ts", F.col("event_id").alias("seq"))
    return jobs.first_submission(e, ["user_id", "event_type"], 86_400).select("seq")


def parse_ocr_jsonl(s: SparkSession, d: str) -> DataFrame:
    """Regions out of recognition JSON that is built from the fixture: one line per page."""
    r = V.regions(s, d)
    one = F.struct("region", F.when(F.col("region") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "text")).alias("t"), F.col("conf").alias("c"), F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(5.0), F.lit(6.0))).alias("p"))
    page = r.groupBy("doc", "page").agg(F.array_sort(F.collect_list(one)).alias("l"))
    pruned = F.struct(F.transform("l", lambda x: x.t).alias("rec_texts"), F.transform("l", lambda x: x.c).alias("rec_scores"), F.transform("l", lambda x: x.p).alias("dt_polys"))
    body = page.select("doc", F.col("page").alias("line_no"), F.to_json(F.struct(F.struct(F.array(F.struct(pruned.alias("prunedResult"))).alias("ocrResults")).alias("result"))).alias("body"))
    return ingest.ocr_regions(body, least=0.95).select("doc", F.col("page_index").cast("long"), F.col("ordinal").cast("long"), "text", F.round("confidence", 4).alias("confidence"), "is_illegible")


def parse_layout_jsonl(s: SparkSession, d: str) -> DataFrame:
    """Pages out of layout JSON that is built from the fixture."""
    b = V.blocks(s, d)
    one = F.struct("block", F.when(F.col("block") % 4 == 0, F.lit("table_body")).otherwise(F.lit("text")).alias("label"), F.when(F.col("block") % 3 != 0, F.col("reading_order")).alias("ord"), "text", F.col("box").alias("bx"))
    page = b.groupBy("doc", "page").agg(F.array_sort(F.collect_list(one)).alias("l"))
    made = F.transform("l", lambda x: F.struct(x.block.cast("string").alias("block_id"), x.label.alias("block_label"), x.ord.alias("block_order"), F.array(x.bx.x * 10, x.bx.y * 10, (x.bx.x + x.bx.w) * 10, (x.bx.y + x.bx.h) * 10).alias("block_bbox"), x.text.alias("block_content")))
    boxes = F.transform("l", lambda x: F.struct(x.ord.alias("order"), (x.block / 100).alias("score")))
    pruned = F.struct(F.lit(1000).alias("width"), F.lit(1000).alias("height"), F.struct(boxes.alias("boxes")).alias("layout_det_res"), made.alias("parsing_res_list"))
    body = page.select("doc", F.col("page").alias("line_no"), F.to_json(F.struct(F.struct(F.array(F.struct(pruned.alias("prunedResult"), F.struct(F.lit("m").alias("text")).alias("markdown"))).alias("layoutParsingResults")).alias("result"))).alias("body"))
    p = ingest.layout_pages(body)
    return p.select("doc", F.col("page_index").cast("long"), F.col("blocks_count").cast("long"), F.col("tables_count").cast("long"), F.array_join("reading_order_sequence", ",").alias("given"), F.array_join(F.transform("blocks", lambda x: x.block_id), ",").alias("sorted"))


def page_text(s: SparkSession, d: str) -> DataFrame:
    """Page texts from lines, documents from pages."""
    r = V.regions(s, d)
    page = r.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region", "text"))), lambda x: x.text), "\n").alias("t"))
    return page.groupBy("doc").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x.t), "\n\n")).alias("markdown"), F.count(F.lit(1)).alias("pages"))


def markdown_export(s: SparkSession, d: str) -> DataFrame:
    """Runs as JSON envelopes; the text of the pages where a run has none of its own."""
    r = table(s, d, "payload").select("parsing_run.id", "parsing_run.markdown_text", F.transform("parsing_run.pages", lambda p: p.markdown_text).alias("md")).dropDuplicates(["id"])
    text = F.coalesce(F.nullif("markdown_text", F.lit("")), F.array_join(F.array_compact("md"), "\n\n"), F.lit(""))
    return r.select("id", F.length(F.to_json(F.struct("id", text.alias("markdown")))).cast("long").alias("json_chars"), F.md5(text).alias("markdown_md5"))


def kv_extract(s: SparkSession, d: str) -> DataFrame:
    r = V.regions(s, d)
    text = F.concat(F.lit("Item: "), F.col("l_partkey"), F.lit("\nWeight : "), F.col("qty"), F.lit(" kg\nno value here\nItem: "), F.col("l_suppkey"))
    m = P.key_values(text)
    return r.select("doc", "region", m["item"].alias("item"), m["weight"].alias("weight"))


def lab_values(s: SparkSession, d: str) -> DataFrame:
    r = V.regions(s, d)
    raw = F.when(F.col("region") % 3 == 0, F.concat(F.col("qty"), F.lit(" - "), F.col("qty") + 5)).when(F.col("region") % 3 == 1, F.concat(F.lit(" "), F.col("qty"), F.lit(".5 "))).otherwise("not detected")
    v = P.lab_value(raw)
    return r.select("doc", "region", v["kind"].alias("kind"), v["low"].alias("low"), v["high"].alias("high"), v["text"].alias("value_text"))


def section_fill(s: SparkSession, d: str) -> DataFrame:
    r = V.regions(s, d)
    head = F.col("region") % 3 == 1
    cells = r.select("doc", "region", F.when(head, F.concat(F.lit("part "), F.col("region"))).otherwise("weight").alias("name"), F.when(~head, F.col("qty").cast("string")).alias("value"), F.when(~head, "kg").alias("unit"), F.lit("").alias("range"))
    return P.lab_rows(cells, ["doc"], "region").select("doc", "region", "section", "value")


def form_fields(s: SparkSession, d: str) -> DataFrame:
    r = V.regions(s, d)
    date = F.substring_index("text", " on ", -1)
    text = F.concat(F.lit("Invoice No: INV-"), F.col("l_partkey"), F.lit("\nDate: "), date, F.when(F.col("qty") % 3 == 0, "\nTotal: $1,").otherwise("\nTotal: 1,"), F.col("qty") + 100, F.lit(".50\nName: Ann Bee\n"), F.when(F.col("qty") % 2 == 0, "Signature").otherwise("7"))
    i, a, t = P.invoice_fields(text), P.application_fields(text), P.text_facts(text)
    return r.select(
        "doc", "region", i["number"].alias("number"), i["total"].alias("total"), i["date"].alias("invoice_date"), a["name"].alias("applicant"), a["has_signature"].alias("has_signature"), a["date"].alias("form_date"),
        t["keys_found"].cast("long").alias("keys_found"), t["document_length"].cast("long").alias("document_length"), F.md5(t["preview"]).alias("preview"),
    )


def html_tables(s: SparkSession, d: str) -> DataFrame:
    """Cells of the table blocks of all runs."""
    b = table(s, d, "payload").select(F.col("parsing_run.id").alias("id"), F.explode("parsing_run.pages").alias("p")).select("id", F.explode("p.blocks").alias("b")).where(F.col("b.content").startswith("<table"))
    rows = b.select("id", F.col("b.block_id").alias("block_id"), "b.content").distinct().select("id", "block_id", F.posexplode(P.html_table(F.col("content"))).alias("row", "cells"))
    return rows.select("id", "block_id", F.col("row").cast("long").alias("row"), F.array_join(F.transform("cells", lambda c: c.text), "|").alias("cells"))


def filename_sanitize(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents", "doc_id", "title")
    name = F.concat(F.lit("../scans/"), "title", F.lit(".pdf"))
    return t.select("doc_id", X.sanitize_filename(name).alias("name"), X.human_size(F.col("doc_id") * 1000 + 7).alias("size"), X.iso_date(F.format_string("%02d-%02d-2024", F.col("doc_id") % 31, F.col("doc_id") % 12)).alias("day"), X.percent((F.col("doc_id") % 8) / 8.0).alias("confidence"))


def upload_validate(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents", "doc_id")
    k = F.col("doc_id") % 6
    head = F.when(k == 0, "25504446").when(k == 1, "89504E470D0A1A0A").when(k == 2, "FFD8FFE0").when(k == 3, "00").when(k == 4, "").otherwise("25504446")
    told = F.when(k == 2, "image/jpg").when(k == 1, "image/png").when(k == 3, "image/png").when((k == 0) & (F.col("doc_id") % 4 == 0), "text/html").otherwise("application/pdf")
    name = F.when(k == 5, "a.png").when(k == 2, "a.jpeg").when(k == 1, "a").otherwise("a.pdf")
    return t.select("doc_id", X.mime_of(F.unhex(head)).alias("mime"), X.upload_error(F.unhex(head), told, name).alias("error"))


def word_boxes(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "benchmark_samples", "sample_id", "ground_truth")
    w = t.select("sample_id", F.size(F.split("ground_truth", " ")).alias("n"), F.posexplode(F.split("ground_truth", " ")).alias("i", "word"))
    return w.select("sample_id", F.col("i").cast("long").alias("i"), "word", F.round(F.col("i") * 100.0 / F.col("n"), 4).alias("x"), F.round(100.0 / F.col("n"), 4).alias("w"))


def update_region_text(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    lines = F.split("text", "\n")
    return t.select("doc_id", F.md5(X.replace_line(F.col("text"), F.get(lines, F.lit(1)), F.lit("NEW LINE"))).alias("updated"))


def reading_confidence(s: SparkSession, d: str) -> DataFrame:
    """Rules on a reading's confidence, and eligibility for another reading."""
    h = V.readings(s, d)
    return h.groupBy("doc", "region").agg(F.round(F.avg("conf"), 6).alias("mean_confidence"), F.count_if(F.col("conf") < 0.30).alias("n_low")).withColumn("eligible", E.recovery_eligible(F.col("n_low") > 0, F.array(F.lit("UNCALIBRATED")), F.col("mean_confidence"), (F.col("region") % 3).cast("int"), F.lit(True)))


# blanks and word characters of any script
_BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_NORM = f"t AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text),'^{_BLANK}+|{_BLANK}+$','','g'),'{_BLANK}+',' ','g') AS n FROM documents WHERE text IS NOT NULL)"
_IN = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
_OUT = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
_EDGE, _END = f"(^|{_OUT})", f"($|{_OUT})"
_JOB = "je AS (SELECT user_id AS job, ts, event_id AS seq, ['queued','submitted','running','completed','failed'][event_id%5+1] AS state FROM events), jc AS (SELECT job, arg_max(state, (ts, seq)) AS state, max(ts) AS last_pulse, count(*) FILTER (WHERE state='failed') AS failures FROM je GROUP BY job)"
_PRED = V.REG + ", pred AS (SELECT doc, region, 'style-'||(l_partkey%4) AS style_category, l_partkey, l_suppkey, text AS gt, CASE WHEN l_partkey%23=0 THEN '' WHEN l_partkey%5=0 THEN replace(text,'weighs','wcigh') WHEN l_partkey%7=0 THEN replace(text,' on ',' ') WHEN l_partkey%11=0 THEN text||' net' WHEN l_suppkey%3=0 THEN replace(text,'1','7') ELSE text END AS pr FROM reg)"
_MET = "count(*) AS samples, sum(length(gt)) AS characters, round(sum(levenshtein(gt,pr))*1.0/sum(length(gt)),6) AS cer, round(avg(CASE WHEN gt=pr THEN 1.0 ELSE 0 END)*100,6) AS exact_match_rate, round(count(*) FILTER (WHERE regexp_replace(gt,'[^0-9]','','g')<>regexp_replace(pr,'[^0-9]','','g'))*1.0/count(*),6) AS numeric_error_rate"
QUERIES = {
    "docs_filter_page": docs_filter_page, "docs_client_filter_sort": docs_client_filter, "evaluations_filter": evaluations_filter, "latest_per_key": latest_per_key, "topk_per_key": topk_per_key, "region_ordinals": region_ordinals, "page_sets": set_operations,
    "metric_cer_by_category": metric_cer_by_category, "metric_wer": metric_wer, "metric_evaluations": metric_evaluations, "metric_latency_percentiles": metric_latency, "dataset_hash": dataset_hash, "dataset_tree": dataset_tree, "style_category": style_category,
    "normalize_tokens": normalize_tokens, "critical_tokens": critical_tokens, "merge_preserve_review": merge_preserve_review, "decision_status": decision_status, "review_queue_counts": review_queue, "unresolved_regions": unresolved_regions, "revision_fold": revision_fold,
    "job_state_fold": job_state_fold, "active_jobs": active_jobs, "stale_jobs": stale_jobs, "dedup_active_submission": first_submissions, "parse_ocr_jsonl": parse_ocr_jsonl, "parse_layout_jsonl": parse_layout_jsonl, "page_text_agg": page_text, "markdown_export": markdown_export,
    "kv_extract": kv_extract, "lab_values": lab_values, "section_fill": section_fill, "form_fields": form_fields, "html_table_rows": html_tables, "filename_sanitize": filename_sanitize, "upload_validate": upload_validate, "word_boxes": word_boxes, "update_region_text": update_region_text,
    "reading_confidence": reading_confidence,
}
SQL = {
    "docs_filter_page": "SELECT doc_id, title FROM documents WHERE source='clinic_scans' AND regexp_matches(title,'(?i)sheet') ORDER BY captured_at DESC, doc_id LIMIT 20 OFFSET 20",
    "docs_client_filter_sort": "SELECT doc_id, title, coalesce(source,'unknown') AS source FROM documents WHERE contains(lower(concat_ws(' ',title,source)),'verso') AND lower(lang)='en' ORDER BY title DESC NULLS LAST, doc_id",
    "evaluations_filter": "SELECT DISTINCT eval_id, benchmark_id FROM sample_evaluations WHERE contains(lower(benchmark_id),'inkreader') AND (confidence IS NULL OR confidence<0.3)",
    "latest_per_key": "SELECT parsing_run.document_id AS document_id, arg_max(parsing_run.id, (parsing_run.created_at, parsing_run.id)) AS id FROM payload GROUP BY 1",
    "topk_per_key": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)<=3",
    "region_ordinals": f"WITH {V.REG} SELECT doc, region, 'reg-p'||page||'-'||lpad(CAST(row_number() OVER (PARTITION BY doc ORDER BY page, region) AS VARCHAR),3,'0') AS region_id FROM reg",
    "page_sets": f"WITH {V.REG} SELECT doc, page, bool_and(l_suppkey%5=0) AS only_regions FROM reg GROUP BY doc, page",
    "metric_cer_by_category": f"WITH {_PRED} SELECT style_category, {_MET} FROM pred GROUP BY 1",
    "metric_wer": f"WITH {_PRED} SELECT style_category, {_MET}, sum(7) AS words, round(sum(CASE WHEN pr='' THEN 7 WHEN l_partkey%5=0 OR l_partkey%7=0 OR l_partkey%11=0 THEN 1 ELSE len(list_filter(list_zip(string_split(gt,' '),string_split(pr,' ')), lambda z: z[1]<>z[2])) END)*1.0/sum(7),6) AS wer FROM pred GROUP BY 1",
    "metric_latency_percentiles": "SELECT event_type, round(avg(value),6) AS mean, round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.9),6) AS p90, round(quantile_cont(value,0.95),6) AS p95, round(min(value),6) AS least, round(max(value),6) AS most FROM events GROUP BY 1",
    "dataset_hash": "SELECT sha256(string_agg(sha256,'' ORDER BY sample_id)) AS dataset_sha256 FROM benchmark_samples",
    "style_category": r"SELECT sample_id, CASE WHEN regexp_matches(ground_truth,'[0-9]') THEN 'numbers_and_punctuation' WHEN regexp_matches(ground_truth,'[,;:" + '"' + r"''!?()-]') AND length(ground_truth)>60 THEN 'punctuation_and_complex' ELSE ['neat','cursive','messy','difficult_faint'][CAST(regexp_extract(sample_id,'(\d+)$',1) AS INTEGER)%4+1] END AS style FROM benchmark_samples",
    "normalize_tokens": f"WITH {_NORM} SELECT doc_id, md5(n) AS normalized, len(list_filter(string_split(n,' '), lambda x: x<>'')) AS n_tokens FROM t",
    "critical_tokens": f"WITH {_NORM}, w AS (SELECT doc_id, unnest(list_filter(string_split(n,' '), lambda x: x<>'')) AS w FROM t) SELECT doc_id, count(*) AS n, count(DISTINCT w) AS n_distinct FROM w WHERE regexp_matches(w,'{_EDGE}\\p{{Nd}}+{_END}') OR regexp_matches(w,'{_EDGE}\\p{{Nd}}+(((mm|cm|m|km|mg|g|kg|ml|l|lb|oz|ft|in|psi|kpa|bar|deg|pc){_END})|%{_IN})') GROUP BY doc_id",
    "dataset_tree": "WITH r AS (SELECT substring(sha256(CAST(l_orderkey AS VARCHAR)),1,3) AS leaf, l_orderkey AS o, sha256(l_orderkey||'|'||l_linenumber||'|'||l_partkey||'|'||l_suppkey) AS h FROM lineitem), l AS (SELECT leaf, sha256(string_agg(h,'' ORDER BY o, h)) AS h FROM r GROUP BY leaf) SELECT sha256(string_agg(h,'' ORDER BY leaf)) AS tree_sha256, count(*) AS leaves FROM l",
    "merge_preserve_review": "WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey%5=0 THEN 'accepted' ELSE 'pending' END AS status, 'old-'||o_orderpriority AS decision FROM orders WHERE o_orderstatus<>'O'), n AS (SELECT o_orderkey AS k, 'pending' AS status, 'new-'||o_orderpriority AS decision FROM orders WHERE o_orderstatus<>'F') SELECT coalesce(n.k,o.k) AS k, CASE WHEN n.k IS NULL OR o.status='accepted' THEN o.status ELSE n.status END AS status, CASE WHEN n.k IS NULL OR o.status='accepted' THEN o.decision ELSE n.decision END AS decision FROM o FULL JOIN n ON o.k=n.k",
    "decision_status": f"WITH {V.REG} SELECT doc, region, CASE WHEN qty%7=0 THEN 'illegible' WHEN qty%2=0 THEN 'accepted' ELSE 'pending' END AS status, 'a,q'||(qty%3)||CASE WHEN region%3<>qty%3 THEN ',q'||(region%3) ELSE '' END AS alternatives FROM reg",
    "review_queue_counts": "WITH i AS (SELECT DISTINCT doc, b.block_id AS block, b.confidence AS confidence FROM (SELECT result_id AS doc, unnest(p.blocks) AS b FROM (SELECT result_id, unnest(pages) AS p FROM prescription_vl_result)) WHERE b IS NOT NULL) SELECT doc, count(*) AS all_items, count(*) FILTER (WHERE coalesce(confidence<0.9,false) AND NOT coalesce(block LIKE '%-1',false)) AS open_items, count(*) FILTER (WHERE block LIKE '%-1') AS verified_items FROM i GROUP BY doc",
    "unresolved_regions": f"WITH {V.REG} SELECT doc, coalesce(string_agg(CASE WHEN qty%4=0 THEN CAST(region AS VARCHAR) END, ',' ORDER BY CAST(region AS VARCHAR)),'') AS unresolved, count(*) FILTER (WHERE qty%4=0)=0 AS complete FROM reg GROUP BY doc",
    "job_state_fold": f"WITH {_JOB} SELECT job, state, strftime(last_pulse,'%Y-%m-%d %H:%M:%S') AS last_pulse, failures FROM jc",
    "active_jobs": f"WITH {_JOB} SELECT job, state FROM jc WHERE state IN ('queued','submitted','running')",
    "stale_jobs": f"WITH {_JOB} SELECT job, CASE WHEN state IN ('queued','submitted','running') AND last_pulse<(SELECT max(ts) FROM je)-INTERVAL 120 SECOND THEN 'timed_out' ELSE state END AS state FROM jc",
    "dedup_active_submission": "SELECT seq FROM (SELECT event_id AS seq, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR ts-b>INTERVAL 86400 SECOND",
    "parse_ocr_jsonl": f"WITH {V.REG}, k AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY region) AS i, dense_rank() OVER (PARTITION BY doc ORDER BY page)-1 AS page_index FROM reg), q AS (SELECT * FROM k WHERE region%5<>0) SELECT doc, page_index, row_number() OVER (PARTITION BY doc ORDER BY page, region) AS ordinal, text, conf AS confidence, conf<0.95 AS is_illegible FROM q",
    "parse_layout_jsonl": f"WITH {V.REG}, k AS (SELECT doc, page, region, row_number() OVER (PARTITION BY doc, page ORDER BY region) AS i FROM reg), o AS (SELECT *, CASE WHEN region%3<>0 THEN region ELSE i END AS ord FROM k) SELECT doc, CAST(page AS BIGINT) AS page_index, count(*) AS blocks_count, count(*) FILTER (WHERE region%4=0) AS tables_count, string_agg(CAST(region AS VARCHAR),',' ORDER BY region) AS given, string_agg(CAST(region AS VARCHAR),',' ORDER BY ord, i) AS sorted FROM o GROUP BY doc, page",
    "page_text_agg": f"WITH {V.REG}, p AS (SELECT doc, page, string_agg(text, chr(10) ORDER BY region) AS t FROM reg GROUP BY doc, page) SELECT doc, md5(string_agg(t, chr(10)||chr(10) ORDER BY page)) AS markdown, count(*) AS pages FROM p GROUP BY doc",
    "kv_extract": f"WITH {V.REG} SELECT doc, region, CAST(l_suppkey AS VARCHAR) AS item, qty||' kg' AS weight FROM reg",
    "lab_values": f"WITH {V.REG} SELECT doc, region, CASE region%3 WHEN 0 THEN 'range' WHEN 1 THEN 'number' ELSE 'text' END AS kind, CASE region%3 WHEN 0 THEN qty WHEN 1 THEN qty+0.5 END AS low, CASE region%3 WHEN 0 THEN qty+5 WHEN 1 THEN qty+0.5 END AS high, CASE WHEN region%3=2 THEN 'not detected' END AS value_text FROM reg",
    "section_fill": f"WITH {V.REG} SELECT doc, region, 'part '||(region-(region-1)%3) AS section, CAST(qty AS VARCHAR) AS value FROM reg WHERE region%3<>1",
    "form_fields": f"WITH {V.REG}, f AS (SELECT *, split_part(text,' on ',2) AS dt, 'Invoice No: INV-'||l_partkey||chr(10)||'Date: '||split_part(text,' on ',2)||chr(10)||CASE WHEN qty%3=0 THEN 'Total: $1,' ELSE 'Total: 1,' END||(qty+100)||'.50'||chr(10)||'Name: Ann Bee'||chr(10)||CASE WHEN qty%2=0 THEN 'Signature' ELSE '7' END AS t FROM reg) "
    "SELECT doc, region, 'INV-'||l_partkey AS number, CASE WHEN qty%3<>0 THEN '1,'||(qty+100)||'.50' END AS total, dt AS invoice_date, CASE WHEN qty%2=0 THEN 'Ann Bee'||chr(10)||'Signature' ELSE 'Ann Bee' END AS applicant, qty%2=0 AS has_signature, dt AS form_date, 4 AS keys_found, length(t) AS document_length, md5(substring(t,1,100)||'...') AS preview FROM f",
    "filename_sanitize": "SELECT doc_id, CASE WHEN coalesce(n,'') IN ('','.','..') THEN 'document' ELSE n END AS name, CASE WHEN (doc_id*1000+7)/1024.0<1024 THEN printf('%.1f KB',(doc_id*1000+7)/1024.0) ELSE printf('%.1f MB',(doc_id*1000+7)/1024.0/1024.0) END AS size, '2024-'||lpad(CAST(doc_id%12 AS VARCHAR),2,'0')||'-'||lpad(CAST(doc_id%31 AS VARCHAR),2,'0') AS day, printf('%.1f%%',(doc_id%8)/8.0*100) AS confidence "
    r"FROM (SELECT doc_id, substring(regexp_replace(title||'.pdf','[^a-zA-Z0-9_\-. ]','_','g'),1,150) AS n FROM documents)",
    "upload_validate": "WITH k AS (SELECT doc_id, doc_id%6 AS k FROM documents) SELECT doc_id, CASE WHEN k IN (0,5) THEN 'application/pdf' WHEN k=1 THEN 'image/png' WHEN k=2 THEN 'image/jpeg' END AS mime, CASE WHEN k=4 THEN 'EMPTY_FILE' WHEN k=0 AND doc_id%4=0 THEN 'UNSUPPORTED_TYPE' WHEN k=3 THEN 'UNKNOWN_SIGNATURE' WHEN k=5 THEN 'EXTENSION_MISMATCH' END AS error FROM k",
    "word_boxes": "WITH t AS (SELECT sample_id, string_split(ground_truth,' ') AS w FROM benchmark_samples) SELECT sample_id, CAST(unnest(range(len(w))) AS BIGINT) AS i, unnest(w) AS word, round(unnest(range(len(w)))*100.0/len(w),4) AS x, round(100.0/len(w),4) AS w FROM t",
    "update_region_text": "WITH t AS (SELECT doc_id, string_split(text,chr(10)) AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN len(list_filter(l, lambda x: x=l[2]))=1 THEN md5(array_to_string(list_transform(l, lambda x: CASE WHEN x=l[2] THEN 'NEW LINE' ELSE x END),chr(10))) END AS updated FROM t",
    "reading_confidence": f"WITH {V.HYP} SELECT doc, region, round(avg(conf),6) AS mean_confidence, count(*) FILTER (WHERE conf<0.3) AS n_low, region%3<2 AND (count(*) FILTER (WHERE conf<0.3)>0 OR avg(conf)<0.4) AS eligible FROM hyp GROUP BY doc, region",
    "markdown_export": "WITH r AS (SELECT DISTINCT ON (parsing_run.id) parsing_run.id AS id, parsing_run.markdown_text AS m, list_transform(parsing_run.pages, lambda p: p.markdown_text) AS l FROM payload), t AS (SELECT id, coalesce(nullif(m,''), array_to_string(list_filter(l, lambda x: x IS NOT NULL), chr(10)||chr(10)), '') AS t FROM r) SELECT id, md5(t) AS markdown_md5, CAST(length(to_json({'id': id, 'markdown': t})) AS BIGINT) AS json_chars FROM t",
    "html_table_rows": "WITH b AS (SELECT DISTINCT id, b.block_id AS block_id, b.content AS c FROM (SELECT id, unnest(p.blocks) AS b FROM (SELECT parsing_run.id AS id, unnest(parsing_run.pages) AS p FROM payload)) WHERE b.content LIKE '<table%'), r AS (SELECT id, block_id, regexp_extract_all(c,'<tr>(.*?)</tr>',1) AS l FROM b), e AS (SELECT id, block_id, CAST(unnest(range(len(l))) AS BIGINT) AS row, unnest(l) AS t FROM r) SELECT id, block_id, row, array_to_string(regexp_extract_all(t,'<td>(.*?)</td>',1),'|') AS cells FROM e",
    "revision_fold": "WITH e AS (SELECT user_id AS doc, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events), f AS (SELECT *, min(seq) FILTER (WHERE event_id%3=0) OVER (PARTITION BY doc) AS stop FROM e) SELECT doc, seq, stop IS NULL OR seq<stop AS accepted, CASE WHEN stop IS NULL THEN seq ELSE least(seq, stop-1) END AS revision FROM f",
}
