"""Queries of runs, review sessions, job polling and the small projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as P
from ..functions import text as X
from ..operators import metrics, review, store
from ..operators import evidence as E
from ..sources.tables import table
from ..streaming import jobs
from . import evidence, stores, tables
from . import fixtures as V

REGIONS = ["r1", "r2", "r3"]


def _runs(s: SparkSession, d: str) -> DataFrame:
    """Orders as runs of their customer's document."""
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("completed")
    return table(s, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("key"), state.alias("status"), F.col("o_orderdate").alias("created_at"))


def live_runs(s: SparkSession, d: str) -> DataFrame:
    return store.live_run(_runs(s, d), ["doc", "key"])


def runs_filter(s: SparkSession, d: str) -> DataFrame:
    """The newest 50 runs of a document and session: the page that is asked for."""
    page = store.filtered(_runs(s, d).withColumn("order", F.struct("created_at", "id")), "order", 50, status="completed", key="1-URGENT", doc=None)
    return page.select("id", "doc")


def finalized_runs(s: SparkSession, d: str) -> DataFrame:
    counted = V.regions(s, d).groupBy(F.col("doc").alias("id")).agg(F.count(F.lit(1)).alias("region_count"), F.count_if(F.col("qty") % 4 == 0).alias("pending_count"))
    return store.finalize(_runs(s, d), counted, "id").select("id", "status", "region_count", "pending_count")


def run_proposals(s: SparkSession, d: str) -> DataFrame:
    """Runs with their proposals by page."""
    p = V.regions(s, d).select(F.col("doc").alias("id"), "page", "region")
    return store.with_children(_runs(s, d).select("id"), p, "id", ["page", "region"], "proposals").select("id", F.array_join(F.transform("proposals", lambda x: F.concat_ws(":", x.page, x.region)), ",").alias("proposals"))


def _items(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "prescription_vl_result").select(F.col("result_id").alias("doc"), F.explode("pages").alias("p")).select("doc", F.explode("p.blocks").alias("b")).where("b IS NOT NULL")
    return v.select("doc", F.col("b.block_id").alias("block"), F.col("b.confidence").alias("confidence")).distinct()


def review_views(s: SparkSession, d: str) -> DataFrame:
    view = review.queue_view(F.col("confidence"), F.coalesce(F.col("block").endswith("-1"), F.lit(False)))
    return _items(s, d).select("doc", "block", "confidence", F.explode(view).alias("view")).groupBy("doc", "view").agg(F.count(F.lit(1)).alias("n"))


def pending_regions(s: SparkSession, d: str) -> DataFrame:
    """Regions that nobody has corrected."""
    r = V.regions(s, d).select("doc", "region", "qty")
    return r.join(r.where("qty % 3 = 0").select("doc", "region"), ["doc", "region"], "left_anti").select("doc", "region")


def next_open(s: SparkSession, d: str) -> DataFrame:
    return review.next_open(V.regions(s, d).select("doc", "region", "qty"), ["doc"], "region", F.col("qty") % 3 == 0).select("doc", "region", "next_open")


def workspace_stats(s: SparkSession, d: str) -> DataFrame:
    """Documents, regions that are open, and decisions, over the whole workspace."""
    return V.regions(s, d).agg(F.countDistinct("doc").alias("documents"), F.count_if(F.col("qty") % 4 == 0).alias("pending"), F.count_if(F.col("qty") % 4 != 0).alias("decisions"))


def recount_after_edit(s: SparkSession, d: str) -> DataFrame:
    """Proposals per document counted anew after some were replaced."""
    old = V.regions(s, d).select("doc", "region", (F.col("qty") % 2 == 0).alias("requires_review"))
    new = V.regions(s, d).where("qty > 40").select("doc", "region", F.lit(False).alias("requires_review"))
    return review.upsert(old, new, ["doc", "region"]).groupBy("doc").agg(F.count_if("requires_review").alias("review"), F.count_if(~F.col("requires_review")).alias("proposable"))


def client_documents(s: SparkSession, d: str) -> DataFrame:
    """Documents as a client gets them: a status that it knows, and defaults for what is missing."""
    t = table(s, d, "documents", "doc_id", "title", "lang", "source", "page_count", "n_chars")
    status = X.client_status(F.col("source"), ("clinic_scans", "letters"), "other")
    return t.select("doc_id", F.coalesce("title", F.lit("untitled")).alias("name"), F.coalesce("lang", F.lit("unknown")).alias("language"), F.coalesce("page_count", F.lit(1)).cast("long").alias("pages"), status.alias("status"), X.human_size(F.coalesce("n_chars", F.lit(0))).alias("size"))


def saved_states(s: SparkSession, d: str) -> DataFrame:
    r = V.regions(s, d)
    long = F.repeat(F.lit("x"), F.lit(120))
    fix = F.create_map(F.lit("r1"), F.when(F.col("qty") % 2 == 0, "one").otherwise(" "), F.lit("r2"), F.when(F.col("qty") % 3 == 0, long).otherwise("two"), F.lit("r3"), F.lit("three"), F.lit("other"), F.lit("no"))
    event = lambda n, time: F.struct(F.lit(n).alias("id"), F.lit("a").alias("action"), F.lit("d").alias("detail"), time.alias("time"))
    events = F.array(event("e1", F.lit("2026-01-02T03:04:05")), event("e2", F.when(F.col("qty") % 5 == 0, "no time").otherwise("2026-01-02")))
    raw = F.to_json(F.struct(F.col("text"), F.lit(True).alias("reviewed"), fix.alias("corrections"), F.struct(F.when(F.col("qty") % 7 == 0, " ").otherwise("ann").alias("reviewer")).alias("preferences"), events.alias("events")))
    state = review.saved_state(F.when(F.col("qty") % 11 == 0, F.substring(raw, 1, 20)).otherwise(raw), REGIONS)
    return r.select("doc", "region", state.alias("s")).select("doc", "region", F.col("s").isNotNull().alias("valid"), F.array_join(F.array_sort(F.map_keys("s.corrections")), ",").alias("corrected"), F.size("s.events").cast("long").alias("events"), "s.reviewed")


def _now(e: DataFrame) -> DataFrame:
    return e.agg(F.max("ts").alias("now"))  # one row


def polled_jobs(s: SparkSession, d: str) -> DataFrame:
    e = tables._job_events(s, d)
    return jobs.poll(jobs.current(e).crossJoin(F.broadcast(_now(e))), F.col("now"), F.col("job") % 3 == 0).select("job", "state", "failures")


def watched_jobs(s: SparkSession, d: str) -> DataFrame:
    e = tables._job_events(s, d)
    started = e.groupBy("job").agg(F.min("ts").alias("started"))
    return jobs.watchdog(jobs.current(e).join(started, "job").crossJoin(F.broadcast(_now(e))), F.col("now"), F.col("started")).select("job", "state", "failures")


def cancelled_jobs(s: SparkSession, d: str) -> DataFrame:
    """A user's cancellation is an event like others; the last one says the state."""
    e = tables._job_events(s, d)
    return jobs.current(e.withColumn("state", F.when(F.col("seq") % 7 == 0, "cancelled").otherwise(F.col("state")))).where("state = 'cancelled'").select("job")


def heartbeats(s: SparkSession, d: str) -> DataFrame:
    """Pulses of a job while it runs, one a minute, counted."""
    runs = table(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return jobs.pulses(runs, "user_id", "a", "b", 3600).groupBy("user_id").agg(F.count(F.lit(1)).alias("pulses"))


def submissions(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("task"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, "end").when(F.col("event_id") % 5 == 0, "force").otherwise("submit").alias("kind"))
    return jobs.submissions(e, ["doc", "task"], ["ts", "seq"]).select("seq", "outcome")


def envelopes(s: SparkSession, d: str) -> DataFrame:
    r = V.regions(s, d)
    error = X.envelope_error(F.when(F.col("qty") % 5 == 0, 10010).when(F.col("qty") % 5 == 1, 7).when(F.col("qty") % 5 != 2, 0), F.when(F.col("qty") % 3 != 0, "job"), F.when(F.col("qty") % 2 == 0, "no").otherwise(""))
    return r.select("doc", "region", error.alias("error"))


def timestamps(s: SparkSession, d: str) -> DataFrame:
    r = V.regions(s, d)
    day = F.concat(F.lit("2026-01-"), F.lpad((F.col("qty") % 28 + 1).cast("string"), 2, "0"))
    raw = F.when(F.col("region") % 4 == 0, F.concat(day, F.lit("T10:00:00Z"))).when(F.col("region") % 4 == 1, F.concat(day, F.lit("T10:00:00+02:00"))).when(F.col("region") % 4 == 2, F.concat(day, F.lit("T10:00:00"))).otherwise("no time")
    return r.select("doc", "region", F.date_format(X.to_utc(raw), "yyyy-MM-dd HH:mm:ss").alias("utc"))


def evidence_reference(s: SparkSession, d: str) -> DataFrame:
    """What a proposal refers to: region, page, the alignment and its IoU."""
    a = evidence.alignment(s, d).where("region IS NOT NULL")
    ref = F.struct("region", "page", F.when(F.col("block").isNotNull(), store.stable_id("align", F.col("doc"), F.col("region"), F.col("block"))).alias("alignment_id"), F.col("iou").alias("alignment_iou"))
    return a.select("doc", ref.alias("e")).select("doc", "e.region", "e.page", "e.alignment_id", "e.alignment_iou")


def evidence_view(s: SparkSession, d: str) -> DataFrame:
    """Regions with what is known of each: proposal, reasons, alignment and the attempts that were run; every side is one row a region before it is joined."""
    a = stores.recovery_budget(s, d).where("status = 'RUN'").select("doc", "region", store.stable_id("att", F.col("doc"), F.col("region")).alias("attempt_id"))
    one = a.groupBy("doc", "region").agg(F.array_sort(F.collect_list("attempt_id")).alias("attempts"))
    return evidence.region_evidence(s, d).select("doc", "region", "reasons", "status").join(one, ["doc", "region"], "left").select("doc", "region", "reasons", "status", F.array_join("attempts", ",").alias("attempts"))


def benchmark_report(s: SparkSession, d: str) -> DataFrame:
    return metrics.report(tables.metric_cer_by_category(s, d), "style_category")


def numeric_errors(s: SparkSession, d: str) -> DataFrame:
    """Numbers of the recorded evaluations, each evaluation once: where the digits of the truth are not those of the prediction."""
    t = table(s, d, "sample_evaluations", "eval_id", "style_category", "ground_truth", "prediction").dropDuplicates(["eval_id"])
    rows = t.select("style_category", X.digits(F.coalesce("ground_truth", F.lit(""))).alias("a"), X.digits(F.coalesce("prediction", F.lit(""))).alias("b"), (F.coalesce("ground_truth", F.lit("")) == F.coalesce("prediction", F.lit(""))).alias("same"))
    return rows.groupBy("style_category").agg(F.count(F.lit(1)).alias("samples"), F.count_if("same").alias("exact"), F.count_if(F.col("a") != "").alias("with_digits"), F.count_if((F.col("a") != "") & (F.col("a") != F.col("b"))).alias("wrong_digits"))


def token_probability(s: SparkSession, d: str) -> DataFrame:
    h = E.collect(V.readings(s, d), ["doc", "region"])
    return h.select("doc", "region", F.round(metrics.mean_probability(F.transform("hyps", lambda x: F.when(x.conf >= 0.2, x.conf))), 6).alias("probability"))


def candidates(s: SparkSession, d: str) -> DataFrame:
    return V.readings(s, d).select("doc", "region", F.col("ord").cast("long"), review.candidate(F.col("text"), F.col("conf"), F.col("model")).alias("c")).select("doc", "region", "ord", "c.confidence", "c.calibrated_score", "c.provider_id")


def patients(s: SparkSession, d: str) -> DataFrame:
    r = V.regions(s, d)
    title = F.when(F.col("qty") % 3 == 0, "Mrs. ").when(F.col("qty") % 3 == 1, "dr ").otherwise("")
    p = P.person(F.concat(title, F.lit("Ann "), F.col("l_partkey")))
    a = P.age_sex(F.when(F.col("qty") % 4 == 0, "unknown").otherwise(F.concat(F.col("qty"), F.lit(" y / f"))))
    return r.select("doc", "region", p["salutation"].alias("salutation"), p["name"].alias("name"), a["age"].cast("long").alias("age"), a["unit"].alias("unit"), a["sex"].alias("sex"))


def edits(s: SparkSession, d: str) -> DataFrame:
    """Edits of a user's document with what came of them; every third is of the whole transcript."""
    e = tables.revision_fold(s, d)
    return e.withColumn("region", F.when(F.col("seq") % 3 != 0, F.col("seq")))


def audit(s: SparkSession, d: str) -> DataFrame:
    return review.audit_rows(edits(s, d), F.col("seq") % 4 == 0).select("doc", "seq", "revision", "action")


def sessions(s: SparkSession, d: str) -> DataFrame:
    e = edits(s, d).where("accepted")
    regions = edits(s, d).where("region IS NOT NULL").select("doc", "region", F.when(F.col("accepted"), "accepted").otherwise("pending").alias("status"))
    docs = table(s, d, "events").select(F.col("user_id").alias("doc")).distinct()
    return review.session(docs, regions, e, "doc").select("doc", F.size(F.coalesce("regions", F.array().cast("array<struct<region:bigint,status:string>>"))).cast("long").alias("regions"), "events", "revision", "reviewed")


_RUNS = "r AS (SELECT o_orderkey AS id, o_custkey AS doc, o_orderpriority AS key, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'completed' END AS status, o_orderdate AS created_at FROM orders)"
_ITEMS = "it AS (SELECT DISTINCT doc, b.block_id AS block, b.confidence AS confidence FROM (SELECT doc, unnest(p.blocks) AS b FROM (SELECT result_id AS doc, unnest(pages) AS p FROM prescription_vl_result)) WHERE b IS NOT NULL)"
_ED = "e AS (SELECT user_id AS doc, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events), f AS (SELECT *, min(seq) FILTER (WHERE event_id%3=0) OVER (PARTITION BY doc) AS stop FROM e), g AS (SELECT doc, seq, stop IS NULL OR seq<stop AS accepted, CASE WHEN stop IS NULL THEN seq ELSE least(seq, stop-1) END AS revision FROM f)"
_ACTIVE = "state IN ('queued','submitted','running')"
QUERIES = {
    "run_idempotency": live_runs, "runs_filter": runs_filter, "run_finalized": finalized_runs, "run_proposals": run_proposals, "review_views": review_views, "pending_regions": pending_regions, "next_open_region": next_open,
    "workspace_stats": workspace_stats, "recount_after_edit": recount_after_edit, "client_documents": client_documents, "saved_state": saved_states, "job_poll_expiry": polled_jobs, "job_watchdog": watched_jobs, "job_cancelled": cancelled_jobs,
    "job_heartbeats": heartbeats, "active_submission": submissions, "provider_envelope": envelopes, "utc_timestamps": timestamps, "evidence_reference": evidence_reference, "evidence_view": evidence_view, "benchmark_report": benchmark_report, "metric_numeric_error": numeric_errors,
    "token_probability": token_probability, "recognition_candidates": candidates, "lab_patient": patients, "audit_rows": audit, "review_session": sessions,
}
SQL = {
    "run_idempotency": f"WITH {_RUNS} SELECT doc, key, min(id) AS id FROM r WHERE status<>'failed' GROUP BY doc, key",
    "runs_filter": f"WITH {_RUNS} SELECT id, doc FROM r WHERE status='completed' AND key='1-URGENT' ORDER BY created_at DESC, id DESC LIMIT 50",
    "run_finalized": f"WITH {_RUNS}, c AS (SELECT l_orderkey AS id, count(*) AS region_count, count(*) FILTER (WHERE CAST(l_quantity AS BIGINT)%4=0) AS pending_count FROM lineitem GROUP BY 1) SELECT r.id, CASE WHEN c.id IS NULL THEN status ELSE 'completed' END AS status, region_count, pending_count FROM r LEFT JOIN c USING (id)",
    "run_proposals": f"WITH {V.REG}, p AS (SELECT doc AS id, string_agg(page||':'||region, ',' ORDER BY page, region) AS proposals FROM reg GROUP BY doc) SELECT o_orderkey AS id, coalesce(proposals,'') AS proposals FROM orders LEFT JOIN p ON p.id=o_orderkey",
    "review_views": f"WITH {_ITEMS}, v AS (SELECT doc, unnest(list_filter(['all', CASE WHEN confidence<0.9 AND NOT coalesce(suffix(block,'-1'),false) THEN 'needs_review' END, CASE WHEN suffix(block,'-1') THEN 'verified' END], lambda x: x IS NOT NULL)) AS view FROM it) SELECT doc, view, count(*) AS n FROM v GROUP BY doc, view",
    "pending_regions": f"WITH {V.REG} SELECT doc, region FROM reg WHERE qty%3<>0",
    "next_open_region": f"WITH {V.REG} SELECT a.doc, a.region, min(b.region) AS next_open FROM reg a LEFT JOIN reg b ON a.doc=b.doc AND b.qty%3=0 AND b.region<>a.region GROUP BY a.doc, a.region",
    "workspace_stats": f"WITH {V.REG} SELECT count(DISTINCT doc) AS documents, count(*) FILTER (WHERE qty%4=0) AS pending, count(*) FILTER (WHERE qty%4<>0) AS decisions FROM reg",
    "recount_after_edit": f"WITH {V.REG} SELECT doc, count(*) FILTER (WHERE qty<=40 AND qty%2=0) AS review, count(*) FILTER (WHERE qty>40 OR qty%2<>0) AS proposable FROM reg GROUP BY doc",
    "client_documents": "SELECT doc_id, coalesce(title,'untitled') AS name, coalesce(lang,'unknown') AS language, coalesce(page_count,1) AS pages, CASE WHEN source IN ('clinic_scans','letters') THEN source ELSE 'other' END AS status, CASE WHEN coalesce(n_chars,0)/1024.0<1024 THEN printf('%.1f KB', coalesce(n_chars,0)/1024.0) ELSE printf('%.1f MB', n_chars/1024.0/1024.0) END AS size FROM documents",
    "saved_state": f"WITH {V.REG}, k AS (SELECT doc, region, qty, qty%7<>0 AND qty%11<>0 AS valid FROM reg) SELECT doc, region, valid, CASE WHEN valid THEN concat_ws(',', CASE WHEN qty%2=0 THEN 'r1' END, CASE WHEN qty%3<>0 THEN 'r2' END, 'r3') END AS corrected, CASE WHEN valid THEN CASE WHEN qty%5=0 THEN 1 ELSE 2 END END AS events, CASE WHEN valid THEN qty%2=0 AND qty%3<>0 END AS reviewed FROM k",
    "job_poll_expiry": f"WITH {tables._JOB}, n AS (SELECT *, {_ACTIVE} AND job%3<>0 AND last_pulse < (SELECT max(ts) FROM events) - INTERVAL 120 SECOND AS gone FROM jc) SELECT job, CASE WHEN gone THEN 'failed' ELSE state END AS state, failures + CASE WHEN gone THEN 1 ELSE 0 END AS failures FROM n",
    "job_watchdog": f"WITH {tables._JOB}, n AS (SELECT jc.*, {_ACTIVE} AND b.started < (SELECT max(ts) FROM events) - INTERVAL 180 SECOND AS gone FROM jc JOIN (SELECT job, min(ts) AS started FROM je GROUP BY job) b USING (job)) SELECT job, CASE WHEN gone THEN 'failed' ELSE state END AS state, failures + CASE WHEN gone THEN 1 ELSE 0 END AS failures FROM n",
    "job_cancelled": "SELECT user_id AS job FROM events GROUP BY user_id HAVING arg_max(event_id%7=0, (ts, event_id))",
    "job_heartbeats": "SELECT user_id, 1+CAST(floor(epoch(max(ts)-min(ts))/3600) AS BIGINT) AS pulses FROM events GROUP BY user_id",
    "active_submission": "WITH e AS (SELECT event_id AS seq, CASE WHEN event_id%4=0 THEN 'end' WHEN event_id%5=0 THEN 'force' ELSE 'submit' END AS kind, user_id, event_type, ts FROM events), l AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY user_id, event_type ORDER BY ts, seq),'end') AS before FROM e) SELECT seq, CASE WHEN before='end' THEN 'started' WHEN kind='force' THEN 'replaced' ELSE 'joined' END AS outcome FROM l WHERE kind<>'end'",
    "provider_envelope": f"WITH {V.REG} SELECT doc, region, CASE WHEN qty%5=0 THEN 'QUEUE_FULL' WHEN qty%5>2 AND qty%3<>0 THEN NULL WHEN qty%2=0 THEN 'no' ELSE 'UNKNOWN' END AS error FROM reg",
    "utc_timestamps": f"WITH {V.REG}, t AS (SELECT doc, region, '2026-01-'||lpad(CAST(qty%28+1 AS VARCHAR),2,'0') AS day FROM reg) SELECT doc, region, CASE WHEN region%4=3 THEN NULL ELSE day||CASE WHEN region%4=1 THEN ' 08:00:00' ELSE ' 10:00:00' END END AS utc FROM t",
    "evidence_reference": f"WITH RECURSIVE {V.ALIGN} SELECT r.doc, r.region, r.page, CASE WHEN al.block IS NOT NULL THEN 'align-'||substring(sha256(r.doc||'|'||r.region||'|'||al.block),1,8) END AS alignment_id, al.iou AS alignment_iou FROM reg r LEFT JOIN al USING (doc, region)",
    "evidence_view": f"WITH v AS ({evidence.SQL['region_evidence']}), {stores._BUDGET} SELECT v.doc, v.region, v.reasons, v.status, CASE WHEN st.status='RUN' THEN 'att-'||substring(sha256(v.doc||'|'||v.region),1,8) END AS attempts FROM v LEFT JOIN st ON st.doc=v.doc AND st.region=v.region",
    "benchmark_report": f"WITH {tables._PRED}, m AS (SELECT style_category, {tables._MET} FROM pred GROUP BY 1) SELECT '| style_category | samples | cer | exact |'||chr(10)||'|---|---|---|---|'||chr(10)||string_agg('| '||style_category||' | '||samples||' | '||printf('%.4f',cer)||' | '||printf('%.2f',exact_match_rate)||' |', chr(10) ORDER BY style_category) AS markdown, '['||string_agg('{{\"style_category\":\"'||style_category||'\",\"samples\":'||samples||'}}', ',' ORDER BY style_category)||']' AS json FROM m",
    "metric_numeric_error": "WITH t AS (SELECT DISTINCT ON (eval_id) eval_id, style_category, coalesce(ground_truth,'') AS g, coalesce(prediction,'') AS p FROM sample_evaluations), x AS (SELECT style_category, g=p AS same, regexp_replace(g,'[^0-9]','','g') AS a, regexp_replace(p,'[^0-9]','','g') AS b FROM t) SELECT style_category, count(*) AS samples, count(*) FILTER (WHERE same) AS exact, count(*) FILTER (WHERE a<>'') AS with_digits, count(*) FILTER (WHERE a<>'' AND a<>b) AS wrong_digits FROM x GROUP BY style_category",
    "token_probability": f"WITH {V.HYP} SELECT doc, region, round(coalesce(avg(conf) FILTER (WHERE conf>=0.2),0.0),6) AS probability FROM hyp GROUP BY doc, region",
    "recognition_candidates": f"WITH {V.HYP} SELECT doc, region, CAST(ord AS BIGINT) AS ord, round(conf,4) AS confidence, round(conf*0.95,4) AS calibrated_score, model AS provider_id FROM hyp",
    "lab_patient": f"WITH {V.REG} SELECT doc, region, CASE qty%3 WHEN 0 THEN 'Mrs.' WHEN 1 THEN 'dr.' END AS salutation, 'Ann '||l_partkey AS name, CASE WHEN qty%4<>0 THEN qty END AS age, CASE WHEN qty%4<>0 THEN 'Y' END AS unit, CASE WHEN qty%4<>0 THEN 'F' END AS sex FROM reg",
    "audit_rows": f"WITH {_ED} SELECT doc, seq, revision, CASE WHEN seq%3=0 THEN 'Manual transcript edit' WHEN seq%4=0 THEN 'Marked illegible' ELSE 'Accepted alternative' END AS action FROM g WHERE accepted",
    "review_session": f"WITH {_ED} SELECT doc, count(*) FILTER (WHERE seq%3<>0) AS regions, count(*) FILTER (WHERE accepted) AS events, coalesce(max(revision) FILTER (WHERE accepted),0) AS revision, count(*) FILTER (WHERE seq%3<>0)>0 AND count(*) FILTER (WHERE seq%3<>0 AND NOT accepted)=0 AS reviewed FROM g GROUP BY doc",
}
