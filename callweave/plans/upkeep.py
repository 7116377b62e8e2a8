"""Change-data queries: two snapshots are made from documents by editing a fixed part of the ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import text
from callweave.operators import changes, tables
from callweave.sources.shared import new_folder

from .catalog import query

PRINT_SQL = "sha256(concat_ws(chr(31), coalesce(lang, chr(0)), coalesce(source, chr(0)), coalesce(text, chr(0))))"
SNAPSHOTS = f"""old AS (SELECT doc_id, 1 AS revision, {PRINT_SQL} AS print FROM documents WHERE doc_id % 10 <> 0),
new AS (SELECT doc_id, {PRINT_SQL} AS print FROM (SELECT doc_id, lang, source, CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 9))"""
PLAN_SQL = f"""WITH {SNAPSHOTS},
p AS (SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, CASE WHEN old.print IS NULL THEN 'create' WHEN new.print IS NULL THEN 'keep' WHEN old.print = new.print THEN 'skip' ELSE 'update' END AS action, old.revision AS r FROM old FULL JOIN new ON old.doc_id = new.doc_id)"""


def _print():
    return changes.fingerprint(F.col("lang"), F.col("source"), F.col("text"))


def _snapshots(t):
    docs = t.documents.select("doc_id", "lang", "source", "text")
    old = docs.filter("doc_id % 10 <> 0").select("doc_id", F.lit(1).alias("revision"), _print().alias("print"))
    edited = docs.filter("doc_id % 10 <> 9").withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return old, edited.select("doc_id", _print().alias("print"))


@query("fingerprint", f"SELECT doc_id, {PRINT_SQL} AS print FROM documents")
def fingerprint(t):
    return t.documents.select("doc_id", _print().alias("print"))


@query("cdc_upsert", PLAN_SQL + " SELECT doc_id, action, CASE action WHEN 'create' THEN 1 WHEN 'update' THEN r + 1 ELSE r END AS revision FROM p")
def cdc_upsert(t):
    return changes.plan_upsert(*_snapshots(t), "doc_id")


@query("ingest_report", PLAN_SQL + " SELECT action, count(*) AS rows FROM p GROUP BY 1")
def ingest_report(t):
    return changes.report(changes.plan_upsert(*_snapshots(t), "doc_id"))


@query("revisions", PLAN_SQL + " SELECT p.doc_id, action, coalesce(old.print, new.print) AS snapshot FROM p LEFT JOIN old ON old.doc_id = p.doc_id LEFT JOIN new ON new.doc_id = p.doc_id WHERE action IN ('create', 'update')")
def revisions(t):
    """A revision keeps the state before an update, or the created state."""
    old, new = _snapshots(t)
    moved = changes.plan_upsert(old, new, "doc_id").filter(F.col("action").isin("create", "update"))
    before = old.select("doc_id", F.col("print").alias("before"))
    after = new.select("doc_id", F.col("print").alias("after"))
    return moved.join(before, "doc_id", "left").join(after, "doc_id", "left").select("doc_id", "action", F.coalesce("before", "after").alias("snapshot"))


@query("chunk_ids", "SELECT doc_id, left(sha1(text), 32) AS content_hash, left(sha1(doc_id || ':0:' || left(sha1(text), 32)), 28) AS chunk_id, greatest(1, length(text) // 4)::INT AS tokens FROM documents")
def chunk_ids(t):
    digest = text.content_hash(F.col("text"))
    return t.documents.select("doc_id", digest.alias("content_hash"), text.chunk_id(F.col("doc_id"), F.lit(0), digest).alias("chunk_id"), text.token_estimate(F.col("text")).alias("tokens"))


@query(
    "cdc_chunks",
    f"WITH {SNAPSHOTS} SELECT doc_id, print, 'add' AS change FROM (SELECT DISTINCT doc_id, print FROM new EXCEPT SELECT doc_id, print FROM old) UNION ALL SELECT doc_id, print, 'remove' FROM (SELECT DISTINCT doc_id, print FROM old EXCEPT SELECT doc_id, print FROM new) UNION ALL SELECT doc_id, print, 'keep' FROM (SELECT DISTINCT doc_id, print FROM new INTERSECT SELECT doc_id, print FROM old)",
)
def cdc_chunks(t):
    old, new = _snapshots(t)
    return changes.chunk_changes(old, new, "doc_id", "print")


@query("delete_by", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by(t):
    return changes.delete_by(t.documents.select("doc_id"), t.labels.filter("toxic = 1"), "doc_id")


@query("bulk_verify", "SELECT d.doc_id, l.doc_id IS NOT NULL AS verified, CASE WHEN l.doc_id IS NOT NULL THEN 2 ELSE 1 END AS revision FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id")
def bulk_verify(t):
    approved = t.labels.filter("quality = 1").select("doc_id").distinct().withColumn("ok", F.lit(True))
    both = t.documents.select("doc_id").join(approved, "doc_id", "left").withColumn("verified", F.coalesce("ok", F.lit(False)))
    return both.select("doc_id", "verified", F.when(F.col("verified"), 2).otherwise(1).alias("revision"))


@query("patch_merge", "SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'patched' END, ''), o_orderstatus) AS status FROM orders")
def patch_merge(t):
    new = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("patched")
    return t.orders.select("o_orderkey", changes.new_or_old(new, F.col("o_orderstatus")).alias("status"))


@query(
    "unanswered_rollup",
    "SELECT event_type || '-' || (event_id % 50) AS canonical_key, count(*) AS occurrences, max(value) AS best_score, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, "
    "arg_max(user_id::VARCHAR, (ts, event_id)) AS intent FROM events GROUP BY 1",
)
def unanswered_rollup(t):
    asked = t.events.select(
        F.concat_ws("-", "event_type", (F.col("event_id") % 50).cast("string")).alias("canonical_key"), F.col("value").alias("score"), "ts", F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("intent"),
    )
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return changes.backlog(asked).select("canonical_key", "occurrences", "best_score", stamp("first_seen"), stamp("last_seen"), "intent")


@query("export_flat", "SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS resolved, o_orderpriority || ';' || o_orderstatus AS tags FROM orders")
def export_flat(t):
    """Flat text columns as a CSV export writes them: lists joined by ;, booleans as words."""
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderstatus") == "F").cast("string").alias("resolved"), F.array_join(F.array("o_orderpriority", "o_orderstatus"), ";").alias("tags")
    )


STAMP = "2024-06-01 00:00:00"  # time of a change; given, so that a repeated change is the same
EDITED_SQL = "SELECT doc_id, lang, source, CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 9"


def _stamp():
    return F.lit(STAMP).cast("timestamp")


def _stored(t):
    """Paths of a table of documents and its history, after the first load and an upsert that is applied twice."""
    path, history = new_folder(t.spark, "records"), new_folder(t.spark, "history")
    docs = t.documents.select("doc_id", "lang", "source", "text")
    state = {"verified": F.lit(False), "verified_by": F.lit(None).cast("string"), "verified_at": F.lit(None).cast("timestamp"), "revision": F.lit(1)}
    first = F.lit("2024-01-01 00:00:00").cast("timestamp")
    tables.create(docs.filter("doc_id % 10 <> 0").withColumns(state | {"created_at": first, "updated_at": first}), path, "doc_id")
    edited = docs.filter("doc_id % 10 <> 9").withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    for _ in range(2):
        tables.upsert(t.spark, path, history, edited, "doc_id", ["lang", "source", "text"], _stamp(), "ingest")
    return path, history


@query(
    "upsert_table",
    f"WITH e AS ({EDITED_SQL}) SELECT coalesce(d.doc_id, e.doc_id) AS doc_id, md5(CASE WHEN e.doc_id IS NULL THEN d.text ELSE e.text END) AS text_md5, CASE WHEN d.doc_id IS NOT NULL AND e.doc_id % 10 = 1 THEN 2 ELSE 1 END AS revision, "
    "(d.doc_id IS NULL OR coalesce(e.doc_id % 10 = 1, false)) AS moved FROM (SELECT * FROM documents WHERE doc_id % 10 <> 0) d FULL JOIN e ON d.doc_id = e.doc_id",
)
def upsert_table(t):
    """The table itself after an upsert of nine tenths of the documents, applied twice."""
    rows = tables.read(t.spark, _stored(t)[0])
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "revision", (F.col("updated_at") == _stamp()).alias("moved"))


@query(
    "upsert_history",
    "SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 2 ELSE 1 END AS revision, CASE WHEN doc_id % 10 = 1 THEN 'update' ELSE 'create' END AS action, 'ingest' AS changed_by, md5(text) AS text_md5, source FROM documents WHERE doc_id % 10 IN (0, 1)",
)
def upsert_history(t):
    """Created states, and states before an update, read out of the VARIANT."""
    rows = tables.read_history(t.spark, _stored(t)[1], "doc_id")
    return rows.select("doc_id", "revision", "action", "changed_by", F.md5(F.variant_get("snapshot", "$.text", "string")).alias("text_md5"), F.variant_get("snapshot", "$.source", "string").alias("source"))


@query(
    "verify_table",
    "WITH v AS (SELECT DISTINCT doc_id AS ok FROM labels WHERE quality = 1) SELECT doc_id, ok IS NOT NULL AS verified, CASE WHEN ok IS NOT NULL THEN 'reviewer' END AS verified_by, "
    "1 + (doc_id % 10 = 1)::INT + (ok IS NOT NULL)::INT AS revision, (doc_id % 10 IN (0, 1))::INT + (ok IS NOT NULL)::INT AS audited FROM documents LEFT JOIN v ON ok = doc_id",
)
def verify_table(t):
    """Bulk verification, applied twice: flag, actor, next revision and an audit row each."""
    path, history = _stored(t)
    for _ in range(2):
        tables.verify(t.spark, path, history, t.labels.filter("quality = 1").select("doc_id"), "doc_id", _stamp(), "reviewer")
    audited = tables.read_history(t.spark, history, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("audited"))
    return tables.read(t.spark, path).join(audited, "doc_id", "left").select("doc_id", F.coalesce("verified", F.lit(False)).alias("verified"), "verified_by", "revision", F.coalesce("audited", F.lit(0)).cast("int").alias("audited"))


@query("delete_cascade", "SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1")
def delete_cascade(t):
    """Orders of one status are deleted with their lines."""
    parents, children = new_folder(t.spark, "parents"), new_folder(t.spark, "children")
    tables.create(t.orders.select("o_orderkey", "o_orderstatus"), parents, "o_orderkey")
    tables.create(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), children, "o_orderkey")
    tables.delete(t.spark, parents, t.orders.filter("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", {children: "l_linenumber"})
    lines = tables.read(t.spark, children).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    return tables.read(t.spark, parents).join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"))


@query(
    "review_append",
    "SELECT documents.doc_id, 1 + count(DISTINCT (quality, toxic)) FILTER (labels.doc_id IS NOT NULL) AS reviews, coalesce(sum(DISTINCT quality), 0)::BIGINT AS good FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id GROUP BY 1",
)
def review_append(t):
    """Labels are appended, twice, to a list that begins with one review."""
    path = new_folder(t.spark, "reviewed")
    start = F.array(F.struct(F.lit("first").alias("by"), F.lit(0).cast("long").alias("quality"), F.lit(0).cast("long").alias("toxic")))
    tables.create(t.documents.select("doc_id", start.alias("reviews")), path, "doc_id")
    said = t.labels.select("doc_id", F.lit("label").alias("by"), F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    for _ in range(2):
        tables.append_reviews(t.spark, path, said, "doc_id", ["by", "quality", "toxic"])
    good = F.aggregate(F.array_distinct(F.transform("reviews", lambda r: r["quality"])), F.lit(0).cast("long"), lambda s, x: s + x)
    return tables.read(t.spark, path).select("doc_id", F.size("reviews").cast("long").alias("reviews"), good.alias("good"))


@query(
    "resolve_backlog",
    "SELECT event_type || '-' || (event_id % 50) AS canonical_key, count(*) AS occurrences, max(event_id % 50) % 7 = 0 AS resolved, CASE WHEN max(event_id % 50) % 7 = 0 THEN 'answered' END AS note FROM events GROUP BY 1",
)
def resolve_backlog(t):
    """Some items of the backlog are resolved; a second note does not change them."""
    path = new_folder(t.spark, "backlog")
    asked = t.events.select(F.concat_ws("-", "event_type", (F.col("event_id") % 50).cast("string")).alias("canonical_key"), (F.col("event_id") % 50 % 7 == 0).alias("done"))
    state = {"resolved": F.lit(False), "resolved_by": F.lit(None).cast("string"), "resolved_at": F.lit(None).cast("timestamp"), "note": F.lit(None).cast("string")}
    tables.create(asked.groupBy("canonical_key").agg(F.count(F.lit(1)).alias("occurrences")).withColumns(state), path, "canonical_key")
    for note in ("answered", "again"):
        tables.resolve(t.spark, path, asked.filter("done").select("canonical_key", F.lit(note).alias("note")), "canonical_key", _stamp(), "staff")
    return tables.read(t.spark, path).select("canonical_key", "occurrences", "resolved", "note")
