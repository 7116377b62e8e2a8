"""Text and classification queries over conversations, documents, parts and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from callweave.functions import batches, classify, languages, passages, text
from callweave.operators import hybrid

from .catalog import query
from .retrieval import DIGEST, DIMS, features_sql, tokens_sql, vectors_sql

KEY_SQL = (
    "(SELECT coalesce(nullif(substr(array_to_string(ws[1:8], ' '), 1, 160), ''), substr(lower(coalesce({c}, '')), 1, 60)) FROM (SELECT list_filter(string_split_regex(regexp_replace(lower(coalesce({c}, '')), "
    "'[^\\p{{L}}\\p{{M}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in text.KEY_STOPWORDS) + ")) AS ws))"
)




@query("canonical_key", f"SELECT conv_id, turn, {KEY_SQL.format(c='text')} AS key FROM conversations")
def canonical_key(t):
    return t.conversations.select("conv_id", "turn", text.canonical_key(F.col("text")).alias("key"))


@query(
    "an_top_queries",
    f"SELECT key, count(*) AS n, arg_min(substr(text, 1, 160), (conv_id, turn, text)) AS example, count(DISTINCT role) AS kinds FROM (SELECT *, {KEY_SQL.format(c='text')} AS key FROM conversations WHERE length(text) >= 4) GROUP BY key ORDER BY n DESC, key LIMIT 100",
)
def an_top_queries(t):
    keyed = t.conversations.filter(F.length("text") >= 4).withColumn("key", text.canonical_key(F.col("text")))
    first = F.min_by(F.substring("text", 1, 160), F.struct("conv_id", "turn", "text"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), first.alias("example"), F.countDistinct("role").alias("kinds")).orderBy(F.col("n").desc(), "key").limit(100)


@query("expand_tokens", f"SELECT doc_id, len({tokens_sql('text')}) AS n_tokens, md5(array_to_string({features_sql('text')}, ' ')) AS features_md5 FROM documents")
def expand_tokens(t):
    both = t.documents.select("doc_id", F.size(text.tokenize(F.col("text"))).alias("n_tokens"), text.expand(F.col("text")).alias("xs"))
    return both.select("doc_id", "n_tokens", F.md5(F.array_join("xs", " ")).alias("features_md5"))


@query("str_clip", "SELECT doc_id, CASE WHEN length(trim(text)) <= 60 THEN trim(text) ELSE regexp_replace(left(trim(text), CASE WHEN cut > 30 THEN cut ELSE 60 END), '[ ,;:.]+$', '') || '…' END AS clipped FROM (SELECT *, CASE WHEN contains(left(trim(text), 60), ' ') THEN 60 - instr(reverse(left(trim(text), 60)), ' ') ELSE 0 END AS cut FROM documents)")
def str_clip(t):
    return t.documents.select("doc_id", text.clip(F.col("text"), 60).alias("clipped"))


@query("header", "SELECT p_partkey, array_to_string(list_distinct_ordered, ' · ') AS header FROM (SELECT p_partkey, CASE WHEN p_brand = p_type THEN [p_brand] ELSE [p_brand, p_type] END AS list_distinct_ordered FROM part)")
def header(t):
    return t.part.select("p_partkey", text.header(F.col("p_brand"), F.col("p_type"), F.col("p_brand"), F.lit(None).cast("string")).alias("header"))


MONEY_SQL = "CASE WHEN {v} >= 1e7 THEN printf('INR %.2f crore', {v} / 1e7) WHEN {v} >= 1e5 THEN printf('INR %.2f lakh', {v} / 1e5) ELSE 'INR ' || format('{{:,}}', round_even({v}, 0)::BIGINT) END"


@query("money_fmt", f"SELECT o_orderkey, {MONEY_SQL.format(v='o_totalprice')} AS money FROM orders")
def money_fmt(t):
    return t.orders.select("o_orderkey", text.money(F.col("o_totalprice")).alias("money"))


@query("parse_money", "SELECT o_orderkey, (CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 100000.0 WHEN o_orderkey % 3 = 1 THEN o_orderkey * 1000.0 ELSE o_orderkey * 1.0 END)::DOUBLE AS amount FROM orders")
def parse_money(t):
    k = F.col("o_orderkey")
    written = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(" lakh"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(" thousand"))).otherwise(F.concat(F.lit("INR "), k.cast("string")))
    return t.orders.select("o_orderkey", text.parse_money(written).alias("amount"))


@query("coerce", "SELECT p_partkey, CAST(try_cast(p_size::VARCHAR AS DOUBLE) AS BIGINT) AS size, len(list_filter(string_split(p_type, ' '), lambda x: x <> '')) AS parts FROM part")
def coerce(t):
    return t.part.select("p_partkey", text.to_int(F.col("p_size").cast("string")).alias("size"), F.size(text.to_list(F.replace("p_type", F.lit(" "), F.lit(";")))).alias("parts"))


@query(
    "normalize_record",
    "SELECT doc_id, coalesce(nullif(trim(lang), ''), 'en') || '-IN' AS language, lower(trim(source)) AS category, left(trim(text), 80) AS title, coalesce(n_chars, 0) > 0 AS filled FROM documents",
)
def normalize_record(t):
    return t.documents.select(
        "doc_id", F.concat(F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("en")), F.lit("-IN")).alias("language"), F.lower(F.trim("source")).alias("category"),
        F.left(F.trim("text"), F.lit(80)).alias("title"), (F.coalesce("n_chars", F.lit(0)) > 0).alias("filled"),
    )


@query("list_join", "SELECT o_custkey, CASE WHEN n = 1 THEN l[1] ELSE array_to_string(l[1:n - 1], ', ') || ' and ' || l[n] END AS listed FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS l, len(list(DISTINCT o_orderpriority)) AS n FROM orders GROUP BY 1)")
def list_join(t):
    return t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("l")).select("o_custkey", text.list_join(F.col("l")).alias("listed"))


@query("tidy", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), ' +([.,!?;:।])', '\\1', 'g'), '[.]{2,}', '.', 'g'), '[!]{2,}', '!', 'g'), '[?]{2,}', '?', 'g'), '[।]{2,}', '।', 'g')) AS tidy FROM conversations")
def tidy(t):
    return t.conversations.select("conv_id", "turn", text.tidy(F.col("text")).alias("tidy"))


@query("is_label", "SELECT doc_id, regexp_matches(text, '^[^.!?]{1,60}:$') OR regexp_matches(text, '^[A-Za-z_]+: [^ ]+$') AS label FROM documents")
def is_label(t):
    return t.documents.select("doc_id", text.is_label(F.col("text")).alias("label"))


@query("pseudonym", "SELECT c_custkey, left(sha256('check:' || trim(c_name)), 16) AS name FROM customer")
def pseudonym(t):
    return t.customer.select("c_custkey", text.pseudonym(F.col("c_name"), "check").alias("name"))


@query("extract_contact", f"SELECT doc_id, regexp_extract(text, '({text.EMAIL})', 1) AS email, regexp_extract(text, '({text.PHONE})', 0) AS phone FROM documents")
def extract_contact(t):
    return t.documents.select("doc_id", text.extract_email(F.col("text")).alias("email"), F.regexp_extract("text", f"({text.PHONE})", 0).alias("phone"))


@query("pii_flag", f"SELECT doc_id, regexp_matches(text, '{text.EMAIL}') AS email, regexp_matches(text, 'https?://\\S+|www\\.\\S+') AS url FROM documents")
def pii_flag(t):
    return t.documents.select("doc_id", F.col("text").rlike(text.EMAIL).alias("email"), F.col("text").rlike(r"https?://\S+|www\.\S+").alias("url"))


@query("followup_body", "SELECT conv_id, array_to_string((list(left(text, 40) ORDER BY turn, role, text))[1:12], chr(10)) AS body FROM conversations WHERE trim(left(text, 40)) <> '' GROUP BY 1")
def followup_body(t):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.left(x["text"], F.lit(40)))
    return t.conversations.filter(F.trim(F.left("text", F.lit(40))) != "").groupBy("conv_id").agg(text.followup_body(lines).alias("body"))


def _words_sql() -> str:
    small = "[" + ", ".join(f"'{u}'" for u in text.UNITS) + "]"
    tens = "[" + ", ".join(f"'{u}'" for u in text.TENS) + "]"
    below = lambda x: f"CASE WHEN {x} < 20 THEN {small}[{x} + 1] ELSE {tens}[{x} // 10 + 1] || CASE WHEN {x} % 10 > 0 THEN ' ' || {small}[{x} % 10 + 1] ELSE '' END END"
    parts = [f"CASE WHEN n // {s} % {m} > 0 THEN ({below(f'(n // {s} % {m})')}) || '{' ' + w if w else ''}' END" for s, m, w in ((10**7, 100, "crore"), (10**5, 100, "lakh"), (1000, 100, "thousand"), (100, 10, "hundred"), (1, 100, ""))]
    return f"CASE WHEN n = 0 THEN 'zero' ELSE concat_ws(' ', {', '.join(parts)}) END"


@query("num_words", f"SELECT o_orderkey, {_words_sql()} AS words FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n FROM orders)")
def num_words(t):
    return t.orders.select("o_orderkey", text.number_words(F.floor("o_totalprice")).alias("words"))


@query("spoken", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'one year' ELSE w || ' years' END AS spoken FROM (SELECT p_partkey, p_size, " + _words_sql() + " AS w FROM (SELECT p_partkey, p_size, p_size::BIGINT AS n FROM part))")
def spoken(t):
    return t.part.select("p_partkey", text.spoken_duration(F.col("p_size")).alias("spoken"))


@query("edge_terms", "SELECT doc_id, len(regexp_extract_all(lower(text), '(^|[^a-z])(licensed|license|copyright)', 2)) AS n FROM documents")
def edge_terms(t):
    """Longest-first terms at a left word edge, without overlap."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("(^|[^a-z])(licensed|license|copyright)"), 2)
    return t.documents.select("doc_id", F.size(found).alias("n"))


@query("speech_sanitize", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[*_#`]', '', 'g'), '&', ' and ', 'g'), '%', ' percent', 'g'), '[ \\n\\t]+', ' ', 'g')) AS spoken FROM conversations")
def speech_sanitize(t):
    out = F.col("text")
    for pattern, by in (("[*_#`]", ""), ("&", " and "), ("%", " percent"), (r"[ \n\t]+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return t.conversations.select("conv_id", "turn", F.trim(out).alias("spoken"))


def _intent_sql(column: str, rules=None) -> str:
    cols = []
    for name, patterns in sorted((rules or classify.INTENTS).items()):
        score = " + ".join(f"CASE WHEN regexp_matches(lower(coalesce({column}, '')), '{p}') THEN {w} ELSE 0 END" for p, w in patterns)
        cols.append(f"{{'s': ({score})::DOUBLE, 'n': '{name}'}}")
    return f"[{', '.join(cols)}]"


@query(
    "intent",
    f"SELECT conv_id, turn, CASE WHEN list_max(list_transform(l, lambda x: x.s)) > 0 THEN list_filter(l, lambda x: x.s = list_max(list_transform(l, lambda y: y.s)))[1].n ELSE 'other' END AS intent FROM (SELECT conv_id, turn, {_intent_sql('text')} AS l FROM conversations)",
)
def intent(t):
    return t.conversations.select("conv_id", "turn", classify.intent(F.col("text"))["label"].alias("intent"))


#: The driver's conversations use made words; these intents are told by the real ones among them, so that each intent occurs.
_WORD = r"(^|[^\p{{L}}])({0})([^\p{{L}}]|$)"
MADE_INTENTS = {"price": [(_WORD.format("the|and"), 1.0), (_WORD.format(r"\p{L}+tion"), 0.4)], "deadline": [(_WORD.format("of|is|in"), 1.0)], "contact": [(_WORD.format("that|with"), 1.2)], "agent": [(_WORD.format("was|on|or"), 1.3), (_WORD.format(r"\p{L}+ing"), 0.2)]}


@query(
    "an_turn_intents",
    f"SELECT CASE WHEN list_max(list_transform(l, lambda x: x.s)) > 0 THEN list_filter(l, lambda x: x.s = list_max(list_transform(l, lambda y: y.s)))[1].n ELSE 'other' END AS intent, count(*) AS n FROM (SELECT {_intent_sql('text', MADE_INTENTS)} AS l FROM conversations WHERE role = 'user' AND turn > 0) GROUP BY 1 ORDER BY n DESC, intent LIMIT 20",
)
def an_turn_intents(t):
    """Intents of user turns, without those of the language stage (a conversation's first turn)."""
    asked = t.conversations.filter("role = 'user' and turn > 0").select(classify.intent(F.col("text"), MADE_INTENTS)["label"].alias("intent"))
    return asked.groupBy("intent").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "intent").limit(20)


_TOPIC = " ".join(f"WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{n}'" for n, p, _ in classify.TOPICS)


@query("topic", f"SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'on_topic' {_TOPIC} ELSE 'unknown' END AS topic FROM documents")
def topic(t):
    return t.documents.select("doc_id", classify.topic(F.col("text"))["label"].alias("topic"))


_MADE = _intent_sql("text", MADE_INTENTS)


@query(
    "control",
    f"SELECT conv_id, turn, n AS label FROM (SELECT conv_id, turn, list_filter(l, lambda x: x.s = list_max(list_transform(l, lambda y: y.s)))[1].n AS n, list_max(list_transform(l, lambda x: x.s)) AS s, list_sum(list_transform(l, lambda x: x.s)) AS total FROM (SELECT conv_id, turn, {_MADE} AS l FROM conversations)) "
    "WHERE s > 0 AND n IN ('agent', 'contact') AND least(0.99, 0.35 + 0.65 * s / greatest(1.0, total) * least(1.0, s / 1.5)) > 0.58",
)
def control(t):
    """Turns that ask for a person or for data, with some confidence."""
    found = t.conversations.select("conv_id", "turn", classify.intent(F.col("text"), MADE_INTENTS).alias("i"))
    return found.filter(F.col("i.label").isin("agent", "contact") & (F.col("i.confidence") > 0.58)).select("conv_id", "turn", "i.label")


@query("pii_request", "SELECT conv_id, turn, regexp_matches(lower(text), '\\b(aadhaar|pan card|otp|password|card number|cvv)\\b') AS asks FROM conversations")
def pii_request(t):
    return t.conversations.select("conv_id", "turn", classify.pii_request(F.col("text")).alias("asks"))


@query("entities", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]{4,}'))), ',') AS numbers FROM documents")
def entities(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]{4,})"), 1))), ",").alias("numbers"))


@query("confirm", "SELECT conv_id, turn, CASE WHEN list_has_any(w, ['no', 'nahi', 'nope', 'wrong', 'not']) THEN 'no' WHEN list_has_any(w, ['yes', 'yeah', 'haan', 'correct', 'right', 'ok', 'okay', 'sure']) THEN 'yes' ELSE 'unclear' END AS said FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations)")
def confirm(t):
    return t.conversations.select("conv_id", "turn", classify.confirmation(F.col("text")).alias("said"))


@query("lang_norm", "SELECT doc_id, CASE lang WHEN 'en' THEN 'en-IN' WHEN 'fr' THEN 'fr-FR' WHEN 'de' THEN 'de-DE' WHEN 'es' THEN 'es-ES' ELSE 'en-IN' END AS code FROM documents")
def lang_norm(t):
    return t.documents.select("doc_id", classify.normal_language(F.concat(F.upper("lang"), F.lit("_in"))).alias("code"))


@query("mode_rule", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'BRASS$') THEN 'rail' WHEN regexp_matches(p_type, 'TIN$') THEN 'air' WHEN regexp_matches(p_type, 'STEEL$|COPPER$') THEN 'road' END AS mode FROM part")
def mode_rule(t):
    ty = F.col("p_type")
    return t.part.select("p_partkey", F.when(ty.rlike("BRASS$"), "rail").when(ty.rlike("TIN$"), "air").when(ty.rlike("STEEL$|COPPER$"), "road").alias("mode"))


LID_SQL = "[" + ", ".join(f"{{'h': len(list_filter(w, lambda x: x IN ({', '.join(repr(m) for m in ms)}))), 'n': '{n}'}}" for n, ms in sorted(classify.MARKERS.items())) + "]"


@query(
    "lid",
    f"SELECT doc_id, CASE WHEN list_max(list_transform(l, lambda x: x.h)) > 0 THEN list_filter(l, lambda x: x.h = list_max(list_transform(l, lambda y: y.h)))[1].n ELSE 'und' END AS language FROM (SELECT doc_id, {LID_SQL} AS l FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS w FROM documents))",
)
def lid(t):
    return t.documents.select("doc_id", classify.language(F.col("text"))["label"].alias("language"))


@query("lid_name", "SELECT conv_id, turn, regexp_extract(lower(text), '\\b(english|hindi|marathi|french|german|spanish)\\b', 1) AS named FROM conversations")
def lid_name(t):
    return t.conversations.select("conv_id", "turn", F.regexp_extract(F.lower("text"), classify.ascii_edges(r"\b(english|hindi|marathi|french|german|spanish)\b"), 1).alias("named"))


@query("lid_fuse", None)
def lid_fuse(t):
    """Text and the table's own language as votes; longer documents are surer of the latter."""
    vote = languages.identified(F.col("text"), classify.normal_language(F.col("lang")), F.least(F.lit(1.0), F.col("n_chars") / 4000))
    return hybrid.spread(t.documents).select("doc_id", vote.alias("v")).select("doc_id", "v.language", F.round("v.confidence", 3).alias("confidence"))


@query("lid_memory", None)
def lid_memory(t):
    """The language that each conversation is held in, turn by turn."""
    return languages.followed(t.conversations)


_RANGES = {s: "".join(f"\\x{{{low:04X}}}-\\x{{{high:04X}}}" for n, low, high in languages.BLOCKS if n == s) for s in languages.SCRIPTS}


@query(
    "script_profile",
    "SELECT doc_id, " + ", ".join(f"CASE WHEN letters = '' THEN 0 ELSE round(length(regexp_replace(letters, '[^{r}]', '', 'g')) / length(letters), 4) END AS {s}" for s, r in _RANGES.items()) + " FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\p{L}]', '', 'g') AS letters FROM documents)",
)
def script_profile(t):
    shares = hybrid.spread(t.documents).select("doc_id", languages.profiles(F.col("text")).alias("p"))
    return shares.select("doc_id", *[F.round(F.get("p", F.lit(i)), 4).alias(s) for i, s in enumerate(languages.SCRIPTS)])


# --- passages, amounts, personal data, vectors


@query("split_sentences", None)
def split_sentences(t):
    return t.documents.select("doc_id", F.size(passages.sentences(F.col("text"))).alias("sentences"))


@query("chunk_text", None)
def chunk_text(t):
    parts = t.documents.select("doc_id", F.posexplode(passages.chunks(F.col("text"))).alias("position", "chunk"))
    return parts.select("doc_id", "position", F.length("chunk").alias("chars"), text.content_hash(F.col("chunk")).alias("content_hash"))


@query("chunk_record", None)
def chunk_record(t):
    """A first chunk of facts, then the body's chunks, each under the record's header."""
    head = text.header(F.col("source"), F.col("lang"))
    facts = F.concat_ws("\n", head, F.concat(F.lit("Characters: "), F.col("n_chars").cast("string")))
    body = F.transform(passages.chunks(F.col("text")), lambda c: F.concat_ws("\n", head, c))
    return t.documents.select("doc_id", F.posexplode(F.concat(F.array(facts), body)).alias("position", "chunk")).select("doc_id", "position", F.length("chunk").alias("chars"))


@query("render_facts", "SELECT p_partkey, 'Brand: ' || p_brand || '. Size: ' || p_size || '. Type: ' || p_type || '.' AS facts FROM part")
def render_facts(t):
    """Any map of facts as labelled sentences, in order of the label."""
    facts = F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    lines = F.transform(F.array_sort(F.map_entries(F.map_filter(facts, lambda k, v: v.isNotNull()))), lambda e: F.concat(F.initcap(e["key"]), F.lit(": "), e["value"], F.lit(".")))
    return t.part.select("p_partkey", F.array_join(lines, " ").alias("facts"))


@query("slugify", None)
def slugify(t):
    return t.documents.select("doc_id", batches.slugify("text").alias("slug"))


@query(
    "hash_embed",
    f"""WITH d AS (SELECT doc_id, {features_sql('text')} AS ws FROM documents), {vectors_sql("dv", "doc_id", "d", "documents")}
SELECT doc_id, count(val) FILTER (val <> 0) AS cells, round(coalesce(max(val), 0), 5) AS peak, round(coalesce(sum(val * cell), 0), 5) AS moment FROM documents LEFT JOIN dv USING (doc_id) GROUP BY 1""",
)
def hash_embed(t):
    """Hashed vectors of whole texts; the vector itself is told by its filled cells, largest value and first moment."""
    vector = batches.hash_embed(text.expand(F.col("text")), text.compact(F.col("text")), DIMS, DIGEST, "double")
    found = t.documents.select("doc_id", vector.alias("v"))
    moment = F.aggregate(F.transform("v", lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return found.select("doc_id", F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("cells"), F.round(F.greatest(F.array_max("v"), F.lit(0.0)), 5).alias("peak"), F.round(moment, 5).alias("moment"))


@query("pii_mask", None)
def pii_mask(t):
    return t.documents.select("doc_id", F.sha2(passages.masked(F.col("text")), 256).alias("masked_sha256"))


@query("numbers", None)
def numbers(t):
    return t.documents.select("doc_id", F.array_join(passages.numbers(F.col("text")), ",").alias("numbers"))


@query("num_grounding", None)
def num_grounding(t):
    """Amounts of assistant turns that no earlier turn of another role holds. Amounts meet by conversation and amount, so no conversation is gathered."""
    said = t.conversations.select("conv_id", "turn", "role", F.explode_outer(passages.numbers(F.col("text"))).alias("number"))
    first = F.min(F.when(F.col("role") != "assistant", F.col("turn"))).over(Window.partitionBy("conv_id", "number"))
    new = F.when(passages.telling(F.col("number")) & (F.col("first").isNull() | (F.col("first") >= F.col("turn"))), F.col("number"))
    by_turn = said.withColumn("first", first).filter("role = 'assistant'").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set(new)).alias("new"))
    return by_turn.select("conv_id", "turn", F.array_join("new", ",").alias("ungrounded"))


@query("speech_split", None)
def speech_split(t):
    return t.conversations.select("conv_id", "turn", F.size(passages.spoken_parts(F.col("text"))).alias("parts"))


@query("voice_scrub", None)
def voice_scrub(t):
    """Markdown and links out, at most 380 characters in whole sentences."""
    plain = text.tidy(F.regexp_replace(F.regexp_replace("text", r"https?://\S+|www\.\S+", ""), "[*_#`>|]", ""))
    parts = F.filter(F.split(plain, r"(?<=[.!?])\s+"), lambda s: s != "")
    fits = F.aggregate(parts, F.lit(""), lambda acc, s: F.when(F.length(acc) + F.length(s) <= 380, F.trim(F.concat_ws(" ", acc, s))).otherwise(acc))
    return t.conversations.select("conv_id", "turn", fits.alias("spoken"))


@query("dbfs", None)
def dbfs(t):
    return t.documents.select("doc_id", F.round(batches.dbfs(F.encode("text", "utf-8")), 4).alias("level"))


@query("augment_query", None)
def augment_query(t):
    """A question with its groups' names added once each, in order."""
    asked = text.expand(F.col("text"))
    added = F.transform(F.filter(asked, lambda x: x.startswith("#g:")), lambda x: F.substring(x, 4, 100))
    return t.benchmark.select("item_id", F.array_join(F.array_distinct(F.concat(text.tokenize(F.col("text")), added)), " ").alias("augmented"))


@query("call_summary", None)
def call_summary(t):
    """First question, intents in order, number of turns: one line per conversation."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "intent", "text")))
    keyed = t.conversations.withColumn("intent", classify.intent(F.col("text"))["label"])
    by = keyed.groupBy("conv_id").agg(turns.alias("turns"))
    first = F.get(F.filter("turns", lambda x: x["role"] == "user"), F.lit(0))["text"]
    intents = F.array_join(F.array_distinct(F.transform("turns", lambda x: x["intent"])), ", ")
    return by.select("conv_id", F.concat_ws(" | ", text.clip(first, 120), intents, F.concat(F.size("turns").cast("string"), F.lit(" turns"))).alias("summary"))
