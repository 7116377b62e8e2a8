"""Search queries: documents are records, benchmark items are questions, embeddings are the vector store."""

from __future__ import annotations


from pyspark.sql import functions as F

from callweave.functions.text import PHRASES, SINGLE, STOPWORDS
from callweave.functions.text import tokenize as tokens_of
from callweave.operators import hybrid, rows, rules, search

from .catalog import query

STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS)
TOKENS_SQL = (
    "list_filter(list_transform(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: regexp_replace(w, '^_+|_+$', '', 'g')), "
    "lambda w: w <> '' AND (length(w) > 1 OR regexp_matches(w, '^[0-9]$')) AND w NOT IN (" + STOP_SQL + "))"
)


def tokens_sql(column: str) -> str:
    return TOKENS_SQL.format(c=column)


GROUPS_SQL = "MAP {" + ", ".join(f"'{w}': '#g:{g}'" for w, g in SINGLE.items()) + "}"


def features_sql(c: str) -> str:
    """SQL list of a text's features, as functions.text.expand gives them."""
    groups = f"flatten(list_transform(ws, lambda w: list_filter([{GROUPS_SQL}[w], CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN {GROUPS_SQL}[left(w, length(w) - 1)] END], lambda g: g IS NOT NULL)))"
    phrases = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(coalesce({c}, '')), '{m}') THEN '#g:{g}' END" for m, g in PHRASES) + "], lambda g: g IS NOT NULL)"
    return f"(SELECT list_concat(list_concat(ws, {groups}), {phrases}) FROM (SELECT {tokens_sql(c)} AS ws))"


INDEX_SQL = f"""d AS (SELECT doc_id, {features_sql('text')} AS ws FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
l AS (SELECT doc_id, greatest(len(ws), 1) AS len FROM d),
c AS (SELECT count(*) AS n, avg(len) AS avg_len FROM l),
qf AS (SELECT item_id, {features_sql('text')} AS ws FROM benchmark),
q AS (SELECT DISTINCT item_id, unnest(ws) AS term FROM qf)"""
BM25_SQL = f"""WITH {INDEX_SQL},
s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.6 / (tf + 1.6 * (1 - 0.72 + 0.72 * len / avg_len))) AS score
 FROM q JOIN p USING (term) JOIN f USING (term) JOIN l USING (doc_id) CROSS JOIN c GROUP BY 1, 2)"""

DIMS, DIGEST = 256, "md5"  # of the queries' vectors; SQL can restate md5
CELL_SQL = f"('0x' || substr(md5('{{salt}}:' || {{x}}), {{at}}, 8))::UBIGINT % {DIMS}"


def vectors_sql(name: str, key: str, rows: str, table: str) -> str:
    """CTEs that end in `name` (key, cell, val): unit vectors as functions.batches.hash_vectors gives them."""
    cell, sign, gram = (CELL_SQL.format(salt=salt, x=x, at=at) for salt, x, at in ((0, "t", 1), (0, "t", 9), (3, "g", 1)))
    return f"""{name}_f AS (SELECT {key}, {cell} AS cell, count(*) AS n, arg_max(1 - 2 * (({sign}) % 2)::INT, i) AS sign FROM (SELECT {key}, unnest(ws) AS t, unnest(range(1, len(ws) + 1)) AS i FROM {rows}) GROUP BY 1, 2),
{name}_x AS (SELECT {key}, regexp_replace(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+', '', 'g') AS x FROM {table}),
{name}_g AS (SELECT {key}, {gram} AS cell, sum(k) AS n FROM (SELECT {key}, substr(x, i, 3) AS g, count(*) AS k FROM (SELECT {key}, x, unnest(range(1, length(x) - 1, 2)) AS i FROM {name}_x) GROUP BY 1, 2) GROUP BY 1, 2),
{name}_v AS (SELECT {key}, cell, coalesce(a.sign * (1 + ln(a.n)), 0) + 0.25 * coalesce(a.sign, 1) * coalesce(b.n, 0) AS val FROM {name}_f a FULL JOIN {name}_g b USING ({key}, cell)),
{name} AS (SELECT {key}, cell, val / sqrt(sum(val * val) OVER (PARTITION BY {key})) AS val FROM {name}_v)"""


@query("tokenize", f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM documents")
def tokenize(t):
    return t.documents.select("doc_id", F.array_join(tokens_of(F.col("text")), " ").alias("tokens"))


@query("bm25_index", f"WITH {INDEX_SQL} SELECT term, df, sum(tf)::BIGINT AS tf FROM p JOIN f USING (term) GROUP BY 1, 2")
def bm25_index(t):
    """Counts of the expanded features: words and synonym groups."""
    return search.postings(t.documents).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query("bm25_delta", f"WITH {INDEX_SQL} SELECT term, count(*) AS df FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def bm25_delta(t):
    """df after the removal of some documents: removed postings are subtracted, terms at 0 go."""
    posts = search.postings(t.documents)
    gone = t.documents.join(t.labels.filter("toxic = 1"), "doc_id", "left_semi")
    minus = search.postings(gone).groupBy("term").agg(F.count(F.lit(1)).alias("minus"))
    left = search.term_df(posts).join(minus, "term", "left").withColumn("df", F.col("df") - F.coalesce("minus", F.lit(0)))
    return left.filter("df > 0").select("term", "df")


@query("bm25_topk", BM25_SQL + " SELECT item_id, doc_id, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 5")
def bm25_topk(t):
    return hybrid.ranked(t.documents, t.benchmark, lexical=5, dense=0).select("item_id", "doc_id", "rank", F.round("score", 4).alias("score"))


VECTOR_QUERIES = "vec_id % 100 = 0"  # the stated query set
COSINE_SQL = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("vec_scan", "SELECT vec_id, len(embedding) AS dims FROM embeddings WHERE len(embedding) = 64")
def vec_scan(t):
    return t.embeddings.filter(F.size("embedding") == 64).select("vec_id", F.size("embedding").alias("dims"))


@query("vec_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def vec_norm(t):
    return t.embeddings.select("vec_id", F.round(search.norm(F.col("embedding")), 6).alias("norm"))


@query("vec_cosine", f"SELECT a.vec_id AS query_id, b.vec_id, round({COSINE_SQL}, 5) AS score FROM embeddings a, embeddings b WHERE a.{VECTOR_QUERIES}")
def vec_cosine(t):
    return search.cosines(t.embeddings, t.embeddings.filter(VECTOR_QUERIES), 5)


@query("vec_topk", f"SELECT query_id, vec_id, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE_SQL}, 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.{VECTOR_QUERIES} AND b.label IN (0, 1, 2)) WHERE rank <= 10")
def vec_topk(t):
    near = search.nearest(t.embeddings.filter(F.col("label").isin(0, 1, 2)), t.embeddings.filter(VECTOR_QUERIES), 10)
    return near.select("query_id", "vec_id", "rank")


@query("vec_l2_topk", f"SELECT query_id, vec_id, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.{VECTOR_QUERIES}) WHERE rank <= 10")
def vec_l2_topk(t):
    return search.nearest(t.embeddings, t.embeddings.filter(VECTOR_QUERIES), 10, "l2").select("query_id", "vec_id", "rank")


@query("vec_upsert", "SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, 99 FROM embeddings WHERE vec_id % 3 = 0")
def vec_upsert(t):
    from callweave.operators.changes import replace_by_key

    old = t.embeddings.select("vec_id", "label")
    new = t.embeddings.filter("vec_id % 3 = 0").select("vec_id", F.lit(99).alias("label"))
    return replace_by_key(old, new, "vec_id")


LEXICAL, DENSE = 24, 48  # sizes of the two lists (fixed values)
LISTS_SQL = f"""{BM25_SQL},
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= {LEXICAL}),
{vectors_sql("qv", "item_id", "qf", "benchmark")},
{vectors_sql("dv", "doc_id", "d", "documents")},
h AS (SELECT item_id, doc_id, sum(qv.val * dv.val) AS score FROM qv JOIN dv USING (cell) GROUP BY 1, 2),
den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM h WHERE score > 0) WHERE rank <= {DENSE})"""
FUSED_SQL = (
    LISTS_SQL
    + """,
u AS (SELECT coalesce(den.item_id, lex.item_id) AS item_id, coalesce(den.doc_id, lex.doc_id) AS doc_id, coalesce(den.rank, 999) AS dense_rank, coalesce(lex.rank, 999) AS lexical_rank,
 coalesce(den.score, 0) AS dense, coalesce(lex.score, 0) AS lexical, coalesce(1.0 / (60 + den.rank), 0) + coalesce(1.0 / (60 + lex.rank), 0) AS rrf
 FROM den FULL JOIN lex ON den.item_id = lex.item_id AND den.doc_id = lex.doc_id)"""
)


def _lists(t):
    return hybrid.ranked(t.documents, t.benchmark, LEXICAL, DENSE, dims=DIMS, digest=DIGEST)


def _fused(t):
    """The best by BM25 over expanded features, and by cosine of hashed vectors."""
    return search.fuse_lists(_lists(t))


@query("dense_topk", LISTS_SQL + " SELECT item_id, doc_id, rank, round(score, 5) AS score FROM den WHERE rank <= 10")
def dense_topk(t):
    """The documents whose hashed vectors lie nearest to a question's, found by matrix products over Arrow batches."""
    found = hybrid.ranked(t.documents, t.benchmark, lexical=0, dense=10, dims=DIMS, digest=DIGEST)
    return found.select("item_id", "doc_id", "rank", F.round("score", 5).alias("score"))


@query("rrf_fuse", FUSED_SQL + " SELECT item_id, doc_id, dense_rank, lexical_rank, round(rrf, 6) AS rrf FROM u")
def rrf_fuse(t):
    return _fused(t).select("item_id", "doc_id", "dense_rank", "lexical_rank", F.round("rrf", 6).alias("rrf"))


# Documents as records: the first two words are the title (the second in brackets where doc_id is even), the next two an
# alias; records of src7 stand for what is not offered. Questions name their first word as a course, their second as a
# specialisation.
WORDS = r"^\s*(\S+)(?:\s+(\S+))?(?:\s+(\S+\s+\S+))?"
FOLD_SQL = "regexp_replace(lower({x}), '[^0-9a-zऀ-ॿ]+', '', 'g')"
FORM_SQL = "trim(regexp_replace(regexp_replace(lower({x}), '[.\\-_/·''’&+]+', '', 'g'), '[^0-9a-zऀ-ॿ]+', ' ', 'g'))"
WHOLE_SQL = "({t} <> '' AND regexp_matches({x}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])\\Q' || {t} || '\\E($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])'))"
HEAD_SQL = r"string_split_regex(title, '[(,/]|\s+(?:or|and|including|such as|with)\s+')[1]"
SQUASH_SQL = "replace(replace(trim({x}), '.', ''), ' ', '')"


def _amount(when: str, amount: str) -> str:
    return f" + CASE WHEN {when} THEN {amount} ELSE 0 END"


RERANK_SQL = (
    FUSED_SQL
    + rf""",
v AS (SELECT doc_id, max(quality) = 1 AS verified FROM labels GROUP BY 1),
m AS (SELECT doc_id, text AS body, source AS category, lang, n_chars, coalesce(verified, false) AS verified, regexp_extract(text, '{WORDS}', 1) || CASE WHEN regexp_extract(text, '{WORDS}', 2) = '' THEN '' WHEN doc_id % 2 = 0 THEN ' (' || regexp_extract(text, '{WORDS}', 2) || ')' ELSE ' ' || regexp_extract(text, '{WORDS}', 2) END AS title, regexp_extract(text, '{WORDS}', 3) AS alias FROM documents LEFT JOIN v USING (doc_id)),
b AS (SELECT item_id, text AS asked, regexp_extract(text, '{WORDS}', 1) AS head, lower(regexp_extract(text, '{WORDS}', 2)) AS spec, 'src' || (item_id % 20)::VARCHAR AS c0, 'src' || ((item_id + 7) % 20)::VARCHAR AS c1 FROM benchmark),
w AS (SELECT *, lower(replace(head, '.', '')) AS code FROM b),
tw AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all({FORM_SQL.format(x="title")}, '[0-9a-zऀ-ॿ]{{3,}}'))) AS word FROM m),
tr AS (SELECT word FROM tw GROUP BY 1 HAVING count(*) <= greatest(2, round_even(0.06 * (SELECT count(*) FROM m), 0))),
ts AS (SELECT item_id, list(word) AS rare FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all({FORM_SQL.format(x="asked")}, '[0-9a-zऀ-ॿ]{{3,}}'))) AS word, {FOLD_SQL.format(x="code")} AS claimed FROM w) WHERE word <> claimed AND word IN (SELECT word FROM tr) GROUP BY 1),
z AS (SELECT u.*, m.body, category, lang, n_chars, verified, w.c0, w.c1, code, spec, lower(asked) AS asked, lower(title) AS title, {FORM_SQL.format(x="asked")} AS form, {FORM_SQL.format(x="title")} AS surface, coalesce(rare, []) AS rare,
 CASE WHEN length({FORM_SQL.format(x="alias")}) >= 4 AND contains({FORM_SQL.format(x="asked")}, {FORM_SQL.format(x="alias")}) THEN 2 ELSE 0 END AS alias_words, {FOLD_SQL.format(x="alias")} AS alias_code,
 {SQUASH_SQL.format(x="string_split_regex(lower(title), '[(—–,]')[1]")} AS prefix, list_transform(regexp_extract_all(lower(title), '\(([^)]+)\)', 1), lambda x: {SQUASH_SQL.format(x="x")}) AS inner_codes,
 ltrim(CASE WHEN contains(m.body, chr(10)) THEN lower(substr(m.body, instr(m.body, chr(10)) + 1)) ELSE '' END, ' ' || chr(9) || chr(10) || chr(13)) LIKE 'also known as:%' AS dump
 FROM u JOIN m USING (doc_id) JOIN w USING (item_id) LEFT JOIN ts USING (item_id)),
y AS (SELECT *, code <> '' AND list_contains(list_filter(list_concat([prefix], inner_codes), lambda x: x <> ''), code) AS exact, {WHOLE_SQL.format(t="spec", x="title")} AS title_spec, {WHOLE_SQL.format(t="spec", x="lower(body)")} AS body_spec,
 len(list_filter(rare, lambda x: contains(' ' || surface || ' ', ' ' || x || ' '))) AS term_hits,
 list_filter([alias_code, {FOLD_SQL.format(x=HEAD_SQL)}, {FOLD_SQL.format(x="string_split(trim(" + HEAD_SQL + "), ' ')[-1]")}], lambda x: x <> '') AS targets FROM z),
r AS (SELECT *, round(greatest(0, 0.75 * rrf / (2.0 / 61) + 0.25 * least(1, dense) + 0.12 * least(1, lexical / 8)"""
    + _amount("category IN (c0, c1)", "0.1") + _amount("category = c0", "0.08") + _amount("lang = 'en'", "0.06") + _amount("verified", "0.05") + _amount("NOT verified", "-0.06") + _amount("n_chars < 200", "-0.07")
    + _amount("code <> '' AND contains(replace(replace(title, '.', ''), ' ', ''), code)", "0.14") + _amount("exact", "0.25")
    + _amount("NOT exact AND code <> '' AND prefix <> '' AND starts_with(prefix, code)", r"CASE WHEN regexp_matches(prefix || ' ' || title, '\+|dual|integrated') THEN 0.04 ELSE 0.18 END")
    + _amount(f"category = 'src7' AND code <> '' AND list_contains(targets, {FOLD_SQL.format(x='code')})", "0.55")
    + _amount("title_spec", "0.45") + _amount("NOT title_spec AND body_spec", "0.04") + _amount("dump", "-0.12") + _amount("NOT dump AND alias_words > 0", "least(0.3, 0.12 + 0.06 * (alias_words - 1))")
    + _amount("NOT dump AND alias_words = 0 AND term_hits > 0", "0.12 * least(2, term_hits)") + _amount("length(title) > 4 AND contains(asked, title)", "0.18") + _amount("category = c0 AND category IN ('src3', 'src4')", "0.08")
    + """), 4) AS final FROM y),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id) AS place FROM r)"""
)


def _records(t):
    first = lambda i: F.regexp_extract("text", WORDS, i)
    title = F.concat(first(1), F.when(first(2) == "", "").when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" ("), first(2), F.lit(")"))).otherwise(F.concat(F.lit(" "), first(2))))
    return hybrid.spread(t.documents).select(
        "doc_id", F.col("text").alias("body"), F.col("source").alias("category"), "lang", title.alias("title"), F.array_remove(F.array(first(3)), "").alias("aliases"), (F.col("n_chars") < 200).alias("stale"),
        F.when(F.col("source") == "src7", F.array(title)).otherwise(F.array().cast("array<string>")).alias("not_offered"),
    )


def _questions(t):
    source = lambda c: F.concat(F.lit("src"), (c % 20).cast("string"))
    word = lambda i: F.regexp_extract("text", WORDS, i)
    return t.benchmark.select(
        "item_id", F.col("text").alias("asked"), F.col("text").alias("spoken"), F.array(source(F.col("item_id")), source(F.col("item_id") + 7)).alias("categories"), source(F.col("item_id")).alias("intent"),
        F.lit("en").alias("language"), F.array(F.upper(word(1))).alias("tokens"), F.array(word(2)).alias("specialisations"),
    )


MOST_CANDIDATES = 200_000  # rows of about 60 bytes that travel to every scan of the records; more are joined by a shuffle


def _candidates(t):
    """Fused hits with their records and questions, and the columns that the rules name."""
    hits, records, questions = _fused(t), _records(t), _questions(t)
    asked = questions.join(rules.title_terms(records, questions), "item_id", "left")
    if t.benchmark.count() * (LEXICAL + DENSE) <= MOST_CANDIDATES:
        hits = F.broadcast(hits)
    verified = t.labels.groupBy("doc_id").agg((F.max("quality") == 1).alias("verified"))
    met = records.join(hits, "doc_id").join(asked, "item_id").join(verified, "doc_id", "left")  # texts meet the hits first
    return rules.features(met.withColumn("verified", F.coalesce("verified", F.lit(False))), timely=("src3", "src4"))


def _reranked(t, k):
    kept = ["item_id", "doc_id", "score", "signals", F.length("body").alias("length")]
    return search.top(rules.rerank(_candidates(t)).select(*kept), k, "item_id")


@query("rerank", RERANK_SQL + " SELECT item_id, doc_id, place AS rank, final AS score FROM k WHERE place <= 5")
def rerank(t):
    return _reranked(t, 5).select("item_id", "doc_id", "rank", "score")


@query("grounded", RERANK_SQL + " SELECT item_id, max(final) AS best, max(final) >= 0.22 AS grounded FROM k WHERE place <= 5 GROUP BY 1")
def grounded(t):
    best = _reranked(t, 5).groupBy("item_id").agg(F.max("score").alias("best"))
    return best.withColumn("grounded", F.col("best") >= 0.22)


@query("context_block", RERANK_SQL + ", x AS (SELECT *, sum(length(body)) OVER (PARTITION BY item_id ORDER BY place) AS running FROM k WHERE place <= 5) SELECT item_id, doc_id, place AS rank, running::BIGINT AS running FROM x WHERE running <= 6000 OR place = 1")
def context_block(t):
    return search.context_block(_reranked(t, 5), "item_id", 6000).select("item_id", "doc_id", "rank", "running")


@query("title_rarity", f"WITH {INDEX_SQL} SELECT term, df FROM f WHERE df <= greatest(2, round_even(0.06 * (SELECT n FROM c), 0)) AND term IN (SELECT term FROM q)")
def title_rarity(t):
    n = t.documents.agg(F.count(F.lit(1)).alias("n"))
    asked = search.question_terms(t.benchmark).select("term").distinct()
    df = search.term_df(search.postings(t.documents)).join(asked, "term", "left_semi").join(F.broadcast(n))  # n is one row
    return df.filter(F.col("df") <= F.greatest(F.lit(2), F.bround(0.06 * F.col("n"), 0))).select("term", "df")


@query("best_sentences", None)
def best_sentences(t):
    """For each question, the sentence of its best document that shares most words with it."""
    best = hybrid.ranked(t.documents, t.benchmark, lexical=1, dense=0).select("item_id", "doc_id")
    joined = best.join(t.documents.select("doc_id", F.col("text").alias("body")), "doc_id").join(t.benchmark, "item_id")
    parts = joined.select("item_id", "doc_id", tokens_of(F.col("text")).alias("asked"), F.posexplode(F.split("body", r"(?<=[.!?])\s+")).alias("pos", "sentence"))
    scored = parts.filter(F.length("sentence") <= 240).withColumn("score", F.size(F.array_intersect("asked", tokens_of(F.col("sentence")))))
    return rows.latest(scored, "item_id", F.col("score").desc(), F.col("pos")).select("item_id", "doc_id", "pos", "sentence", "score")


@query("vec_ann", None)
def vec_ann(t):
    """Approximate neighbours through an inverted file written to the shared folder; probes are learned on a sample."""
    from callweave.operators.ann import neighbours
    from callweave.sources.shared import new_folder

    return neighbours(t.embeddings, t.embeddings.filter(VECTOR_QUERIES), 10, new_folder(t.spark, "vectors"))


@query(
    "bm25_segments",
    f"WITH x AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN text || ' reviewed' ELSE text END AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), d AS (SELECT doc_id, {features_sql('text')} AS ws FROM x), "
    "t AS (SELECT count(*) AS docs, sum(greatest(len(ws), 1))::BIGINT AS words FROM d) SELECT term, count(*) AS df, any_value(docs) AS docs, any_value(words) AS words FROM (SELECT DISTINCT doc_id, unnest(ws) AS term FROM d), t GROUP BY 1",
)
def bm25_segments(t):
    """Statistics of an index that took three batches, replaced and removed documents, and was compacted."""
    from callweave.operators.segments import Segments
    from callweave.sources.shared import new_folder

    index, docs = Segments(t.spark, new_folder(t.spark, "segments")), t.documents.select("doc_id", "text")
    index.add(docs.filter("doc_id % 10 <> 0"))
    index.add(docs.filter("doc_id % 10 = 1").withColumn("text", F.concat("text", F.lit(" reviewed"))))
    index.add(docs.filter("doc_id % 10 = 0"))
    index.remove(t.labels.filter("toxic = 1").select("doc_id"))
    index.compact(docs.count() // 2)
    df, total = index.statistics()
    return df.join(F.broadcast(total))  # one row


WORD = r"[\p{L}\p{M}\p{N}_]"


@query(
    "term_hits",
    f"WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}{{8,}}')) AS term FROM benchmark), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}+')) AS term FROM documents), "
    "h AS (SELECT doc_id, count(*) AS hits, count(DISTINCT term) AS terms FROM w WHERE term IN (SELECT term FROM terms) GROUP BY 1) SELECT doc_id, coalesce(hits, 0) AS hits, coalesce(terms, 0) AS terms FROM documents LEFT JOIN h USING (doc_id)",
)
def term_hits(t):
    """Which long words of the questions each document holds: all of them in one walk over its text."""
    from callweave.functions import terms

    words = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD}{{8,}})"), 1)).alias("term")).distinct().select("term", F.lit(""))
    found = hybrid.spread(t.documents).select("doc_id", terms.find(F.col("text"), words, "word").alias("h"))
    return found.select("doc_id", F.size("h").cast("long").alias("hits"), F.size(F.array_distinct(F.transform("h", lambda x: x["term"]))).cast("long").alias("terms"))


@query("answer", None)
def answer(t):
    """Questions answered in bulk: topic and intent, best documents, the sentence that says most, amounts checked.

    A question without a document at or above the gate, or on a sensitive topic, goes to a person.
    """
    from callweave.functions import classify, passages

    best = _reranked(t, 1).select("item_id", "doc_id", "score")
    asked = t.benchmark.select("item_id", "text", classify.topic(F.col("text"))["label"].alias("topic"), classify.intent(F.col("text"))["label"].alias("intent"))
    found = asked.join(best, "item_id", "left").join(t.documents.select("doc_id", F.col("text").alias("body")), "doc_id", "left")
    parts = found.withColumns({"words": tokens_of(F.col("text")), "parts": F.filter(F.split(F.coalesce("body", F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.length(s) <= 240)})
    scored = F.transform("parts", lambda s, i: F.struct(F.size(F.array_intersect("words", tokens_of(s))).alias("n"), (-i).alias("i"), s.alias("s")))
    said = parts.withColumn("said", F.coalesce(F.array_max(scored)["s"], F.lit("")))
    bad = passages.ungrounded(F.col("said"), F.col("body"))
    checked = said.withColumn("ungrounded", F.size(bad))
    way = F.when(F.col("topic") == "sensitive", "person").when(F.coalesce("score", F.lit(0.0)) < 0.22, "person").when(F.col("ungrounded") > 0, "clarify").otherwise("answer")
    return checked.select("item_id", "topic", "intent", "doc_id", "score", "said", way.alias("decision"))


@query("lookup_facts", RERANK_SQL + " SELECT item_id, string_agg(category || '/' || lang, ',' ORDER BY place) AS facts FROM k WHERE place <= 3 GROUP BY 1")
def lookup_facts(t):
    """Facts of a question's three best records, in order."""
    best = _reranked(t, 3).select("item_id", "doc_id", "rank").join(t.documents.select("doc_id", "source", "lang"), "doc_id")
    facts = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("/", "source", "lang").alias("f")))), lambda x: x["f"])
    return best.groupBy("item_id").agg(F.array_join(facts, ",").alias("facts"))


@query(
    "compose_answers",
    """WITH f AS (SELECT *, p_partkey % 5 AS k, CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS total, CASE WHEN p_size % 3 = 0 THEN p_retailprice / 4 END AS annual, p_partkey % 7 <> 0 AS ok, p_partkey % 4 = 0 AS stale,
 'INR ' || format('{:,}', round_even(p_retailprice, 0)::BIGINT) AS t, 'INR ' || format('{:,}', round_even(p_retailprice / 4, 0)::BIGINT) AS a FROM part),
b AS (SELECT *, CASE WHEN NOT ok THEN 'no_answer' WHEN k = 0 AND total IS NOT NULL AND annual IS NOT NULL THEN 'price_both' WHEN k = 0 AND annual IS NOT NULL THEN 'price_annual' WHEN k = 0 AND total IS NOT NULL THEN 'price_total' WHEN k = 0 THEN 'price_unpublished'
 WHEN k = 1 THEN 'contact' WHEN k = 2 THEN 'documents' WHEN k = 3 THEN 'eligibility_which' ELSE 'overview' END AS branch FROM f)
SELECT p_partkey, branch, CASE branch WHEN 'no_answer' THEN 'I do not have that on record. I can connect you to a person.' WHEN 'price_both' THEN 'The fee is ' || a || ' a year. ' || t || ' in total.' WHEN 'price_annual' THEN 'The fee is ' || a || ' a year.' WHEN 'price_total' THEN 'The total fee is ' || t || '.'
 WHEN 'price_unpublished' THEN 'The fee is not published yet. The office can confirm it.' WHEN 'contact' THEN 'The phone number is ' || p_brand || '. The address is ' || p_name || '.' WHEN 'documents' THEN 'You need ' || replace(p_type, ' ', ', ') || '.' WHEN 'eligibility_which' THEN 'Which programme do you mean.' ELSE p_name || '. There are ' || p_size || ' seats.' END AS answer,
 round(least(0.95, greatest(0.05, 0.6 * CASE WHEN starts_with(branch, 'price') AND p_partkey % 3 <> 0 THEN 0.8 ELSE 1 END * CASE WHEN stale THEN 0.85 ELSE 1 END)), 3)::DOUBLE AS confidence FROM b""",
)
def compose_answers(t):
    """Answers about parts: facts as a VARIANT, the first branch that holds, its sentences under the budget."""
    from callweave.operators.compose import compose

    key, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    facts = F.struct(
        F.struct(F.when(size % 2 == 0, price).alias("total"), F.when(size % 3 == 0, price / 4).alias("annual"), F.lit(False).alias("published")).alias("fees"), F.col("p_brand").alias("phone"), F.col("p_name").alias("address"),
        F.split("p_type", " ").alias("documents_required"), F.col("p_name").alias("answer"), size.alias("seats"),
    )
    intent = F.element_at(F.array(*map(F.lit, ("price", "contact", "documents", "eligibility", "other"))), (key % 5 + 1).cast("int"))
    rows = t.part.select("p_partkey", intent.alias("intent"), (key % 7 != 0).alias("grounded"), (key % 3 == 0).alias("verified"), (key % 4 == 0).alias("stale"), F.lit(0.6).alias("score"), F.parse_json(F.to_json(facts)).alias("facts"))
    return compose(rows).select("p_partkey", "branch", "answer", "confidence")
