"""Filters, joins, windows and call reports over orders (as calls), lineitem (as turns) and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from callweave.operators import rows

from .catalog import query

AS_OF = "1998-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


@query("flt_since", f"SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY")
def flt_since(t):
    return rows.since(t.orders, "o_orderdate", AS_OF, 90).select("o_orderkey", "o_orderstatus")


@query("flt_eq", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def flt_eq(t):
    return rows.equal(t.orders, o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey")


@query("flt_ilike", "SELECT p_partkey FROM part WHERE p_name ILIKE '%re%' OR p_type ILIKE '%re%' OR p_brand ILIKE '%re%'")
def flt_ilike(t):
    return rows.search(t.part, "re", "p_name", "p_type", "p_brand").select("p_partkey")


@query("flt_prefix", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'ECONOMY')")
def flt_prefix(t):
    return t.part.filter(F.col("p_type").startswith("ECONOMY")).select("p_partkey", "p_type")


@query("flt_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def flt_in(t):
    return t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("flt_point", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def flt_point(t):
    return t.customer.filter("c_custkey = 7").select("c_custkey", "c_name")


@query("flt_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE NOT coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) IN (1, 2, 3), false)")
def flt_json(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.withColumn("k", k).filter(~F.coalesce(F.col("k").isin(1, 2, 3), F.lit(False))).select("event_id", "k")


@query("evt_parse", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def evt_parse(t):
    return t.events.select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"))


@query("proj_call", "SELECT o_orderkey AS id, o_orderstatus AS status, round(o_totalprice, 1) AS duration FROM orders")
def proj_call(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.round("o_totalprice", 1).alias("duration"))


@query(
    "proj_citation",
    "SELECT d.doc_id, substr(text, 1, 20) || ' (' || replace(source, '_', ' ') || ')' || CASE WHEN coalesce(max(quality), 0) = 1 THEN '' ELSE ' [unverified]' END AS citation "
    "FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id, text, source",
)
def proj_citation(t):
    verified = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    mark = F.when(F.coalesce("quality", F.lit(0)) == 1, "").otherwise(" [unverified]")
    name = F.concat(F.substring("text", 1, 20), F.lit(" ("), F.replace("source", F.lit("_"), F.lit(" ")), F.lit(")"), mark)
    return t.documents.join(verified, "doc_id", "left").select("doc_id", name.alias("citation"))


@query("proj_stale", f"SELECT o_orderkey, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(o_orderdate)) / 86400000000) > 180 AS stale FROM orders")
def proj_stale(t):
    return t.orders.select("o_orderkey", rows.stale(F.col("o_orderdate"), AS_OF).alias("stale"))


@query("join_inner", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R'")
def join_inner(t):
    turns = t.lineitem.filter("l_returnflag = 'R'")
    calls = t.orders.filter("o_orderstatus = 'F'")
    return turns.join(calls, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("join_published", "SELECT d.doc_id, d.lang FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def join_published(t):
    return t.documents.join(t.labels.filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("join_left_count", "SELECT o_orderkey, n::DOUBLE AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def join_left_count(t):
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return t.orders.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.col("n").cast("double").alias("n"))


@query("join_anti_orphans", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def join_anti_orphans(t):
    live = t.labels.select(F.col("doc_id").alias("vec_id"))
    return t.embeddings.join(live, "vec_id", "left_anti").select("vec_id")


@query("join_nest", "SELECT conv_id, string_agg(turn::VARCHAR || ':' || role, ',' ORDER BY turn, role) AS turns, count(*) AS n FROM conversations GROUP BY conv_id")
def join_nest(t):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    text = F.array_join(F.transform(turns, lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"])), ",")
    return t.conversations.groupBy("conv_id").agg(text.alias("turns"), F.count(F.lit(1)).alias("n"))


@query("transcript_text", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY conv_id")
def transcript_text(t):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n").alias("transcript"))


@query("latest_per_key", "SELECT o_custkey, o_orderkey, o_orderdate::VARCHAR AS at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(t):
    best = t.orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))  # aggregates before it shuffles
    return best.select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"), F.date_format("m.o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("group_by_record", "SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS first_rank, count(*) AS n FROM lineitem GROUP BY l_partkey")
def group_by_record(t):
    return t.lineitem.groupBy("l_partkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_rank"), F.count(F.lit(1)).alias("n"))


@query(
    "merge_facts",
    "SELECT l_orderkey, string_agg(k || '=' || v, ',' ORDER BY k) AS facts FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS k, arg_min(l_linenumber::VARCHAR, l_linenumber) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1",
)
def merge_facts(t):
    first = t.lineitem.groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("k")).agg(F.min("l_linenumber").cast("string").alias("v"))
    facts = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "k", "v"))), ",")
    return first.groupBy("l_orderkey").agg(facts.alias("facts"))


# --- call reports: a call is an order, its duration the price, failed/abandoned/completed its status


@query(
    "an_overview",
    """SELECT count(*) AS total, count(*) FILTER (o_orderpriority = '1-URGENT') AS escalated,
 count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT') AS resolved, count(*) FILTER (o_orderstatus = 'P') AS failed,
 round(count(*) FILTER (o_orderpriority = '1-URGENT') / greatest(1, count(*)), 3) AS escalation_rate,
 round(avg(CASE WHEN o_totalprice <> 0 THEN o_totalprice END), 3) AS avg_duration FROM orders""",
)
def an_overview(t):
    urgent, done = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F"
    return t.orders.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(urgent).alias("escalated"), F.count_if(done & ~urgent).alias("resolved"),
        F.count_if(F.col("o_orderstatus") == "P").alias("failed"),
        F.round(F.count_if(urgent) / F.greatest(F.lit(1), F.count(F.lit(1))), 3).alias("escalation_rate"),
        F.round(F.avg(F.when(F.col("o_totalprice") != 0, F.col("o_totalprice"))), 3).alias("avg_duration"),
    )


@query("an_per_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, count(*) FILTER (event_type = 'error') AS escalated, count(*) FILTER (event_type = 'purchase') AS resolved FROM events WHERE ts IS NOT NULL GROUP BY 1")
def an_per_day(t):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    kinds = [F.count_if(F.col("event_type") == k).alias(n) for k, n in (("error", "escalated"), ("purchase", "resolved"))]
    return t.events.filter("ts is not null").groupBy(day).agg(F.count(F.lit(1)).alias("calls"), *kinds)


@query("an_kb_rate", "SELECT coalesce(sum(n_chars), 0)::BIGINT AS occurrences, count(*) AS total, count(*) FILTER (q = 1) AS verified, round(count(*) FILTER (q = 1) / greatest(1, count(*)), 3) AS rate FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id)")
def an_kb_rate(t):
    verified = t.labels.groupBy("doc_id").agg(F.max("quality").alias("q"))
    n, ok = F.count(F.lit(1)), F.count_if(F.col("q") == 1)
    return t.documents.join(verified, "doc_id", "left").agg(
        F.coalesce(F.sum("n_chars"), F.lit(0)).alias("occurrences"), n.alias("total"), ok.alias("verified"), F.round(ok / F.greatest(F.lit(1), n), 3).alias("rate")
    )


@query("an_languages", "SELECT coalesce(lang, 'unknown') AS language, count(*) AS calls, round(count(*) / sum(count(*)) OVER (), 4) AS share, round(avg(nullif(n_chars, 0)), 3) AS avg_chars FROM documents GROUP BY 1")
def an_languages(t):
    by = t.documents.groupBy(F.coalesce("lang", F.lit("unknown")).alias("language")).agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.avg(F.nullif("n_chars", F.lit(0))), 3).alias("avg_chars")
    )
    return by.withColumn("share", F.round(F.col("calls") / F.sum("calls").over(Window.partitionBy()), 4))


@query("an_primary_intent", "SELECT event_type AS intent, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def an_primary_intent(t):
    return t.events.filter("event_type is not null").groupBy(F.col("event_type").alias("intent")).agg(F.count(F.lit(1)).alias("n"))


@query("an_unanswered", f"SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY AND event_type = 'error' ORDER BY value DESC, event_id LIMIT 50")
def an_unanswered(t):
    recent = rows.since(t.events, "ts", EVENTS_AS_OF, 7).filter("event_type = 'error'")
    return recent.orderBy(F.col("value").desc(), "event_id").limit(50).select("event_id", "value")


_NEAREST = "round(list_sort(list({v}))[1 + round_even({p} * (count({v}) - 1), 0)::BIGINT], 1)"


@query(
    "an_latency",
    "SELECT stage, round(avg(v), 3) AS avg, round(max(v), 1) AS max, "
    + ", ".join(f"{_NEAREST.format(v='v', p=p)} AS p{int(p * 100)}" for p in (0.5, 0.95, 0.99))
    + " FROM (SELECT 'tax' AS stage, l_tax AS v FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'quantity', l_quantity FROM lineitem) GROUP BY stage",
)
def an_latency(t):
    """Stages keep zeros. Ranks come from row numbers, so no group is gathered in an array."""
    long = t.lineitem.selectExpr("stack(3, 'tax', l_tax, 'discount', l_discount, 'quantity', l_quantity) as (stage, v)")
    # few distinct values per stage: count them first, then find ranks among the counts
    counts = long.groupBy("stage", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("stage").orderBy("v")
    at = counts.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy("stage"))})
    pick = lambda p: F.round(F.min(F.when(F.col("upto") > F.bround(p * (F.col("n") - 1), 0), F.col("v"))), 1)
    return at.groupBy("stage").agg(
        F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 3).alias("avg"), F.round(F.max("v"), 1).alias("max"), *[pick(p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    )


@query(
    "an_escalations",
    "SELECT CASE WHEN GROUPING(o_orderpriority) = 0 THEN 'reason' ELSE 'outcome' END AS dimension, coalesce(o_orderpriority, o_orderstatus) AS value, count(*) AS n, round(avg(nullif(o_totalprice, 0)), 2) AS avg_wait FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus))",
)
def an_escalations(t):
    both = t.orders.groupingSets([["o_orderpriority"], ["o_orderstatus"]], "o_orderpriority", "o_orderstatus")
    return both.agg(
        F.when(F.grouping("o_orderpriority") == 0, "reason").otherwise("outcome").alias("dimension"), F.coalesce("o_orderpriority", "o_orderstatus").alias("value"),
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.nullif("o_totalprice", F.lit(0.0))), 2).alias("avg_wait"),
    ).select("dimension", "value", "n", "avg_wait")


@query(
    "an_quality",
    "SELECT w AS warning, count(*) AS n FROM (SELECT unnest(string_split(substr(p_type, 1, 80), ' ')) AS w FROM part) GROUP BY 1 ORDER BY n DESC, w LIMIT 15",
)
def an_quality(t):
    words = t.part.select(F.explode(F.split(F.substring("p_type", 1, 80), " ")).alias("warning"))
    return words.groupBy("warning").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "warning").limit(15)


@query("kb_stats", "SELECT source AS category, count(*) AS total, count(*) FILTER (q = 1) AS verified, count(*) FILTER (coalesce(q, 0) <> 1) AS awaiting FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id) GROUP BY source")
def kb_stats(t):
    verified = t.labels.groupBy("doc_id").agg(F.max("quality").alias("q"))
    return t.documents.join(verified, "doc_id", "left").groupBy(F.col("source").alias("category")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("q") == 1).alias("verified"), F.count_if(F.coalesce("q", F.lit(0)) != 1).alias("awaiting")
    )


@query("idx_stats", "SELECT lang, count(*) AS chunks, count(DISTINCT source) AS records FROM documents GROUP BY lang")
def idx_stats(t):
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source").alias("records"))


@query("page_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def page_count(t):
    return t.orders.filter("o_orderstatus = 'O'").agg(F.count(F.lit(1)).alias("n"))


@query("page_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_rows(t):
    return rows.page(t.orders.select("o_orderkey", "o_totalprice"), 25, 50, F.col("o_totalprice").desc(), F.col("o_orderkey"))


@query("sort_multi", "SELECT conv_id, turn, role FROM conversations")
def sort_multi(t):
    return t.conversations.select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query("topk_freq", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def topk_freq(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "l_partkey").limit(20)


@query("call_rollup", "SELECT l_orderkey, round(avg(l_extendedprice), 6) AS avg_total, min(nullif(l_tax, 0)) AS min_first, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS intents FROM lineitem GROUP BY 1")
def call_rollup(t):
    return t.lineitem.groupBy("l_orderkey").agg(
        F.round(F.avg("l_extendedprice"), 6).alias("avg_total"), F.min(F.nullif("l_tax", F.lit(0.0))).alias("min_first"),
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("intents"),
    )


@query("turn_counters", "SELECT conv_id, count(*) FILTER (role = 'user') AS turn_count, count(*) FILTER (role = 'assistant' AND length(text) < 40) AS unanswered_count FROM conversations GROUP BY 1")
def turn_counters(t):
    role = F.col("role")
    return t.conversations.groupBy("conv_id").agg(
        F.count_if(role == "user").alias("turn_count"), F.count_if((role == "assistant") & (F.length("text") < 40)).alias("unanswered_count")
    )


@query("mode_intent", "SELECT user_id, event_type AS intent FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def mode_intent(t):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.latest(counts, "user_id", F.col("n").desc(), F.col("event_type")).select("user_id", F.col("event_type").alias("intent"))


@query(
    "metrics_last500",
    "SELECT event_type, count(*) AS count, round(avg(value), 3) AS avg, round(list_sort(list(value))[1 + count(*) // 2], 1) AS p50, round(list_sort(list(value))[1 + least(count(*) - 1, floor(count(*) * 0.95)::BIGINT)], 1) AS p95 "
    "FROM (SELECT * FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500) GROUP BY 1",
)
def metrics_last500(t):
    recent = rows.last_n(t.events.filter("value is not null"), "event_type", 500, F.col("ts").desc(), F.col("event_id").desc())
    ordered, n = F.sort_array(F.collect_list("value")), F.count(F.lit(1))  # 500 values at most
    return recent.groupBy("event_type").agg(
        n.alias("count"), F.round(F.avg("value"), 3).alias("avg"), F.round(F.get(ordered, F.floor(n / 2).cast("int")), 1).alias("p50"),
        F.round(F.get(ordered, F.least(n - 1, F.floor(n * 0.95)).cast("int")), 1).alias("p95"),
    )


@query("last_n", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= 3")
def last_n(t):
    return rows.last_n(t.conversations, "conv_id", 3, F.col("turn").desc(), F.col("role").desc(), F.col("text").desc()).select("conv_id", "turn")


@query("lag_overlap", "SELECT conv_id, turn, right(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), ''), 20) AS overlap FROM conversations")
def lag_overlap(t):
    before = F.lag("text", 1, "").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return t.conversations.select("conv_id", "turn", F.right(before, F.lit(20)).alias("overlap"))


@query(
    "streak",
    "WITH h AS (SELECT event_id, user_id, ts, event_type = 'click' AS hit, sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events) "
    "SELECT event_id, sum(hit::BIGINT) OVER (PARTITION BY user_id, island ORDER BY event_id)::BIGINT AS streak FROM h",
)
def streak(t):
    return rows.streak(t.events.select("event_id", "user_id", "event_type"), "user_id", "event_id", F.col("event_type") == "click").select("event_id", "streak")


@query(
    "carry_forward",
    "SELECT event_id, coalesce(p, last_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS carried FROM (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN value END AS p FROM events)",
)
def carry_forward(t):
    bought = t.events.select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("p"))
    return rows.carry_forward(bought, "user_id", "event_id", "p").select("event_id", "carried")


@query("ord_distinct", "SELECT conv_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(list(role)), lambda x: [list_position(list(role ORDER BY turn, role, text), x)::VARCHAR, x])), lambda x: x[2]), ',') AS roles FROM conversations GROUP BY conv_id HAVING count(*) < 10")
def ord_distinct(t):
    """Each conversation's roles by first turn. A role is cut to its first turn before a conversation is gathered."""
    first = t.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))
    roles = F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn").isNull(), "turn", "role"))), lambda x: x["role"])
    return first.groupBy("conv_id").agg(F.array_join(roles, ",").alias("roles"))


@query("setops", "SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def setops(t):
    by = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("key"))
    return by("O").intersect(by("F")).subtract(by("P"))


@query("union_sources", "SELECT 'document' AS kind, doc_id AS id, lang FROM documents UNION ALL SELECT 'benchmark', item_id, NULL FROM benchmark UNION ALL SELECT 'page', page_id, NULL FROM pages")
def union_sources(t):
    docs = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "lang")
    bench = t.benchmark.select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"))
    pages = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"))
    return docs.unionByName(bench, allowMissingColumns=True).unionByName(pages, allowMissingColumns=True)


# --- streams, as batches: gaps, sessions, waits


@query("gaps", "SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE epoch_us(nxt) - epoch_us(ts) > 3600000000")
def gaps(t):
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = F.unix_micros(F.col("nxt").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", "ts", nxt.alias("nxt")).filter(gap > 3_600_000_000).select("event_id")


@query("max_duration", "SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) > 86400000000 AS too_long FROM events GROUP BY 1")
def max_duration(t):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return t.events.groupBy("user_id").agg((us(F.max("ts")) - us(F.min("ts")) > 86_400_000_000).alias("too_long"))


@query(
    "sessionize",
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessionize(t):
    events = t.events.filter("ts is not null").withColumn("at", F.col("ts").cast("timestamp"))
    by = events.groupBy("user_id", F.session_window("at", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return by.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("final_only", "SELECT user_id, arg_max(event_id, event_id) AS last_click FROM events WHERE event_type = 'click' GROUP BY 1")
def final_only(t):
    return t.events.filter("event_type = 'click'").groupBy("user_id").agg(F.max_by("event_id", "event_id").alias("last_click"))


@query(
    "wait_join",
    "SELECT r.event_id, epoch(min(o.ts)) - epoch(any_value(r.ts)) AS wait_seconds FROM events r JOIN events o ON r.user_id = o.user_id AND o.event_type = 'purchase' AND o.ts > r.ts WHERE r.event_type = 'signup' GROUP BY 1",
)
def wait_join(t):
    """The next outcome after each request: one window per user, no join of all pairs."""
    both = t.events.filter("event_type in ('signup', 'purchase')").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(1, Window.unboundedFollowing)
    nxt = F.min(F.when(F.col("event_type") == "purchase", F.col("us"))).over(w)
    asked = both.withColumn("nxt", nxt).filter("event_type = 'signup' and nxt is not null")
    return asked.select("event_id", (F.col("nxt") / 1e6 - F.col("us") / 1e6).alias("wait_seconds"))


@query(
    "overlap",
    "SELECT a.l_orderkey, a.l_linenumber FROM lineitem a WHERE (SELECT count(*) FROM lineitem b WHERE a.l_orderkey = b.l_orderkey AND abs(date_diff('day', a.l_shipdate, b.l_shipdate)) <= 7) > 1",
)
def overlap(t):
    """Speech and playback overlap if a neighbour in time lies within the span."""
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber")
    near = lambda c: F.abs(F.datediff("l_shipdate", c)) <= 7
    both = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", F.lag("l_shipdate").over(w).alias("before"), F.lead("l_shipdate").over(w).alias("after"))
    return both.filter(F.coalesce(near("before"), F.lit(False)) | F.coalesce(near("after"), F.lit(False))).select("l_orderkey", "l_linenumber")


@query(
    "handoff",
    "SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 60), ' | ' ORDER BY turn, role, text) AS brief FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= 8) GROUP BY 1",
)
def handoff(t):
    recent = rows.last_n(t.conversations, "conv_id", 8, F.col("turn").desc(), F.col("role").desc(), F.col("text").desc())
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), F.substring(x["text"], 1, 60)))
    return recent.groupBy("conv_id").agg(F.array_join(lines, " | ").alias("brief"))


@query(
    "decision",
    "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'i''m not sure') OR contains(lower(text), 'transfer you') THEN 'abstain' WHEN turn < 2 THEN 'abstain' WHEN length(text) < 50 THEN 'clarify' ELSE 'answer' END AS decision FROM conversations WHERE role = 'assistant'",
)
def decision(t):
    """Answer, clarify or abstain; phrases are compared in lower case on both sides."""
    low = F.lower("text")
    unsure = low.contains("i'm not sure") | low.contains("transfer you")
    what = F.when(unsure | (F.col("turn") < 2), "abstain").when(F.length("text") < 50, "clarify").otherwise("answer")
    return t.conversations.filter("role = 'assistant'").select("conv_id", "turn", what.alias("decision"))
