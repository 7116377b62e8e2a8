"""Sources, sinks and lookups: files written and read back, a stream into a table, routes, expiring entries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from callweave.functions import classify
from callweave.sources import readers
from callweave.sources.shared import new_folder
from callweave.streaming import calls

from .catalog import query


@query("src_csv", "SELECT p_partkey::VARCHAR AS slug, trim(p_name) AS title, p_size::VARCHAR AS size FROM part")
def src_csv(t):
    path = new_folder(t.spark, "csv")
    readers.write_csv(t.part.select(F.col("p_partkey").alias("Slug"), F.concat(F.lit(" "), "p_name").alias("Title"), F.col("p_size").alias("Size")), path)
    return readers.read_csv(t.spark, path).select("slug", "title", "size")


@query("src_json", "SELECT n_nationkey, n_name FROM nation")
def src_json(t):
    path = new_folder(t.spark, "json")
    wrapped = t.nation.groupBy().agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("items"))  # 25 rows of a fixed table
    wrapped.write.json(path)
    return readers.read_json(t.spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("src_folder", "SELECT 'nation' AS kind, count(*) AS records FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def src_folder(t):
    """A folder with files of several formats."""
    path = new_folder(t.spark, "seed")
    t.nation.select(F.col("n_name").alias("title"), F.lit("nation").alias("kind")).coalesce(1).write.csv(f"{path}/a", header=True)
    t.region.select(F.col("r_name").alias("title"), F.lit("region").alias("kind")).groupBy().agg(F.collect_list(F.struct("title", "kind")).alias("records")).write.json(f"{path}/b")
    found = readers.read_folder(t.spark, path).filter("position >= 0")
    return found.groupBy(F.get_json_object("record", "$.kind").alias("kind")).agg(F.count(F.lit(1)).alias("records"))


@query("src_yaml", None)
def src_yaml(t):
    """YAML records; where the yaml package is absent, one row tells so."""
    path = new_folder(t.spark, "yaml")
    lines = t.region.select(F.concat(F.lit("- {title: '"), "r_name", F.lit("', key: "), F.col("r_regionkey").cast("string"), F.lit("}")).alias("value"))
    lines.coalesce(1).write.text(path)
    named = readers.read_folder(t.spark, path, "yaml")
    return named.select("position", F.get_json_object("record", "$.title").alias("title"))


@query("stream_sink", "SELECT event_type AS canonical_key, count(*) AS occurrences, max(value) AS best_score FROM events GROUP BY 1")
def stream_sink(t):
    """Events as a stream of files, merged batch by batch into a snapshot table."""
    folder = new_folder(t.spark, "sink")
    live = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.sf_dir}/events.parquet*")
    asked = live.select(F.col("event_type").alias("canonical_key"), F.col("value").alias("score"))
    numbers: list[int] = []
    write = calls.merge_backlog(t.spark, folder)

    def each(batch, number: int) -> None:
        write(batch, number)
        numbers.append(number)

    q = asked.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}-log").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(f"{folder}/{max(numbers)}")


@query("ttl", "SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 600000000 THEN lag(event_id) OVER w END::DOUBLE AS pending FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def ttl(t):
    """The entry that is still pending when an event comes: the one before, if it is at most 600 seconds old."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", F.when(us - F.lag(us).over(w) <= 600_000_000, F.lag("event_id").over(w)).cast("double").alias("pending"))


@query("lid_only", "SELECT conv_id, turn, len(w) > 0 AND len(list_filter(w, lambda x: x NOT IN ('english', 'hindi', 'marathi', 'french', 'german', 'spanish', 'please', 'in', 'only'))) = 0 AS only_language FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations)")
def lid_only(t):
    names = [n for n in classify.LANGUAGE_CODES if len(n) > 2] + ["french", "german", "spanish", "please", "in", "only"]
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    only = (F.size(words) > 0) & (F.size(F.array_except(words, F.array(*[F.lit(n) for n in names]))) == 0)
    return t.conversations.select("conv_id", "turn", only.alias("only_language"))


@query("route_lookup", "SELECT s_suppkey, coalesce(CASE WHEN n_regionkey < 3 THEN n_name END, 'GENERAL') AS route FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def route_lookup(t):
    """Contact route by key, with a general one where there is none. The routes are a fixed table of 25 rows."""
    routes = t.nation.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("route"))
    return t.supplier.join(F.broadcast(routes), "s_nationkey", "left").select("s_suppkey", F.coalesce("route", F.lit("GENERAL")).alias("route"))


@query("escalation_plan", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'queue' WHEN o_totalprice > 100000 THEN 'number' ELSE 'none' END AS target_type FROM orders")
def escalation_plan(t):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "queue").when(F.col("o_totalprice") > 100000, "number").otherwise("none")
    return t.orders.select("o_orderkey", kind.alias("target_type"))


@query("script_mix", "SELECT doc_id, lang = 'en' AS english, regexp_matches(text, '[^\\x00-\\x7F]') AS beyond_ascii FROM documents")
def script_mix(t):
    return t.documents.select("doc_id", (F.col("lang") == "en").alias("english"), F.col("text").rlike(r"[^\x00-\x7F]").alias("beyond_ascii"))


FIELDS = [
    ("id", "id", "int"), ("title", "title", "text"), ("tags", "tags", "list"), ("verified", "verified", "bool"), ("fee_total", "structured.fees.total", "float"), ("fee_currency", "structured.fees.currency", "text"),
    ("seats", "structured.seats", "int"), ("modes", "structured.modes", "list"), ("hostel", "structured.hostel.offered", "bool"), ("note", "structured.hostel.note", "text"),
]


@query(
    "export_round",
    "SELECT p_partkey AS id, p_name AS title, array_to_string(string_split(p_type, ' '), '/') AS tags, p_size > 25 AS verified, p_retailprice AS fee_total, 'INR' AS fee_currency, p_size::BIGINT AS seats, p_partkey % 3 = 0 AS hostel FROM part",
)
def export_round(t):
    """Records with a VARIANT, flattened, written as CSV, read and built up again."""
    from callweave.sources import flat

    made = F.to_json(F.struct(
        F.struct(F.col("p_retailprice").alias("total"), F.lit("INR").alias("currency")).alias("fees"), F.col("p_size").alias("seats"), F.split("p_brand", "#").alias("modes"), F.struct((F.col("p_partkey") % 3 == 0).alias("offered"), F.lit('a "quoted", note').alias("note")).alias("hostel"),
    ))
    records = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.split("p_type", " ").alias("tags"), (F.col("p_size") > 25).alias("verified"), F.parse_json(made).alias("structured"))
    path = new_folder(t.spark, "flat")
    readers.write_csv(flat.flatten(records, FIELDS), path)
    back = flat.unflatten(readers.read_csv(t.spark, path), FIELDS)
    place = lambda p, kind: F.variant_get("structured", f"$.{p}", kind)
    return back.select("id", "title", F.array_join("tags", "/").alias("tags"), "verified", place("fees.total", "double").alias("fee_total"), place("fees.currency", "string").alias("fee_currency"), place("seats", "bigint").alias("seats"), place("hostel.offered", "boolean").alias("hostel"))
