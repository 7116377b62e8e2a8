"""URL filtering by rules and by a path-template tree per host with smoothed labelled purity.

Rules (host and path prefix) decide first; the longest that fits wins. Elsewhere the verdict is that of
the url's template. Templates come from counted tables, never from a host's urls gathered in one task:

1. Segments become lexical classes: numbers {n}, hexadecimal {h}, others with digits {x}; words stay. An
   extension stays beside its class.
2. Wherever a tree node, at any depth, has more than MAX_BRANCH different word children, they become {s}; this
   is repeated with the new prefixes until no node is wide.
3. Templates of a host that differ in one word, at any place, are merged ({*}) when a two-sample test of
   proportions (|z| < Z_SAME) finds no difference between the block share of a branch and that of its siblings
   without it; the largest pool goes first, and this is repeated until nothing merges.
4. A template's purity is (blocked + K * host's purity) / (labelled + K); the host's is smoothed in the same way
   towards its domain's (the last two names): the share of its hosts, unlabelled ones too, that are mostly
   blocked, smoothed towards BASE. A template with a purity of REJECT or more is blocked.

Only labelled rows count in 3 and 4. Labels are a column of the input (block, allow or null), or the page's own
evidence (`evidence`): block by a seed word in host or path, allow by an article in a page of MIN_HTML characters
or more, else none. Rows that a rule decides have no label: a rule for one path says nothing of its host's others. Defined cases: a null url or one without '://' has empty host
and path and no rule; an empty path has one empty segment; urls are read whole, however long; repeated rows count
as often as they come and are judged alike; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, table

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
SEEDS = ("casino", "pills", "adult", "free-bets", "ads-track", "spam-")
MAX_BRANCH, Z_SAME, K, BASE, REJECT, MIN_HTML = 24, 1.96, 2.0, 0.05, 0.5, 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last `when` set is the first tried
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """Lexical classes of the path's segments."""
    lower = F.translate(F.regexp_replace(path, "^/", ""), UPPER, LOWER)

    def kind(seg: Column) -> Column:
        stem, ext = F.regexp_replace(seg, r"\.[a-z]{1,5}$", ""), F.regexp_extract(seg, r"\.[a-z]{1,5}$", 0)
        name = F.when(stem.rlike("^[0-9]+$"), "{n}").when(stem.rlike("^[0-9a-f]{8,}$"), "{h}").when(stem.rlike("[0-9]"), "{x}").otherwise(stem)
        return F.concat(name, ext)

    return F.transform(F.split(lower, "/"), kind)


def _joined(segs: Column) -> Column:
    return F.array_join(segs, "/")


def evidence(host: Column, path: Column, html: Column, seeds=SEEDS) -> Column:
    """block, allow or null, by what the page itself shows."""
    marked = F.lit(False)
    for word in seeds:
        marked = marked | host.contains(word) | path.contains(word)
    article = html.contains("<article") & (F.length(html) >= MIN_HTML)
    return F.coalesce(F.when(marked, "block"), F.when(article, "allow"))


def _is_word(seg: Column) -> Column:
    return (seg != "") & ~seg.startswith("{")


def _generalised(counts: DataFrame) -> DataFrame:
    """Replace words under wide nodes until none is left; counts has host, lexical, segs, n, blocked, labelled."""
    while True:
        node = lambda s, i: F.struct(F.xxhash64(F.array_join(F.slice("segs", F.lit(1), i), "/"), i).alias("prefix"), s.alias("seg"))
        at = counts.select("host", "lexical", F.posexplode(F.transform("segs", node)).alias("place", "node")).filter(_is_word(F.col("node.seg")))
        at = at.select("host", "lexical", "place", "node.prefix", "node.seg")
        wide = at.groupBy("host", "prefix", "seg").agg(F.lit(1).alias("one")).groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("words"))
        wide = materialise(wide.filter(F.col("words") > MAX_BRANCH).select("host", "prefix"), "url-wide")
        if wide.isEmpty():
            discard(wide)
            return counts
        places = at.join(wide, ["host", "prefix"]).groupBy("host", "lexical").agg(F.collect_set("place").alias("places"))
        segs = F.transform("segs", lambda s, i: F.when(F.array_contains("places", i), F.lit("{s}")).otherwise(s))
        nxt = materialise(counts.join(places, ["host", "lexical"], "left").withColumn("segs", F.when(F.col("places").isNull(), F.col("segs")).otherwise(segs)).drop("places"), "url-level")
        discard(counts, wide)
        counts = nxt


def same_share(blocked: Column, n: Column, other_blocked: Column, other_n: Column) -> Column:
    """Two-sample test of proportions with pooled spread; samples without labels differ from nothing."""
    share = (blocked + other_blocked) / (n + other_n)
    spread = F.sqrt(share * (1 - share) * (1 / n + 1 / other_n))
    gap = F.abs(blocked / n - other_blocked / other_n)
    return F.when((n == 0) | (other_n == 0), F.lit(True)).otherwise(gap < Z_SAME * spread + 1e-9)


def _merged(counts: DataFrame) -> DataFrame:
    """Merge templates that differ in one word, until nothing merges; counts has host, lexical, segs, labelled, blocked."""
    while True:
        templates = counts.groupBy("host", "segs").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
        shape = lambda s, i: F.struct(F.xxhash64(F.array_join(F.transform("segs", lambda t, j: F.when(i == j, F.lit("{*}")).otherwise(t)), "/")).alias("shape"), s.alias("seg"))
        at = templates.select("host", "segs", "n", "b", F.posexplode(F.transform("segs", shape)).alias("place", "it")).filter(_is_word(F.col("it.seg")))
        at = materialise(at.select("host", "segs", "n", "b", "place", "it.shape"), "url-shapes")
        pools = at.groupBy("host", "shape", "place").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("all_n"), F.sum("b").alias("all_b")).filter("members > 1")
        pools = materialise(pools, "url-pools")
        both = at.join(pools, ["host", "shape", "place"])
        both = both.filter(same_share(F.col("b"), F.col("n"), F.col("all_b") - F.col("b"), F.col("all_n") - F.col("n")))
        best = both.groupBy("host", "segs").agg(F.max_by("place", F.struct("all_n", "members", -F.col("place"), "shape")).alias("place"))
        best = materialise(best, "url-merges")
        if best.isEmpty():
            discard(at, pools, best)
            return counts
        segs = F.transform("segs", lambda s, i: F.when(i == F.col("place"), F.lit("{*}")).otherwise(s))
        nxt = materialise(counts.join(best, ["host", "segs"], "left").withColumn("segs", F.when(F.col("place").isNull(), F.col("segs")).otherwise(segs)).drop("place"), "url-merged")
        discard(counts, at, pools, best)
        counts = nxt


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS, label_column: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and template and purity of the method."""
    given = F.col(label_column).cast("string") if label_column else F.lit(None).cast("string")
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), given.alias("given"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html", "given")
    rule, by_rule = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": by_rule, "segs": segments(F.col("path"))}).withColumn("lexical", _joined(F.col("segs")))
    label = F.when(F.col("by_rule").isNull(), F.col("given") if label_column else evidence(F.col("host"), F.col("path"), F.col("html"), seeds))
    counts = rows.withColumn("label", label).groupBy("host", "lexical").agg(
        F.first("segs").alias("segs"), F.count("label").alias("labelled"), F.sum((F.coalesce(F.col("label"), F.lit("")) == "block").cast("long")).alias("blocked")
    )
    counts = _merged(_generalised(materialise(counts, "url-counts")))
    named = counts.withColumns({"template": _joined(F.col("segs")), "domain": F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".")})
    named = named.withColumn("domain", F.when(F.col("domain") == "", F.col("host")).otherwise(F.col("domain")))
    smooth = lambda up: (F.sum("blocked") + K * up) / (F.sum("labelled") + K)
    of = named.groupBy("domain", "host").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n")).withColumn("bad", ((F.col("b") > 0) & (2 * F.col("b") >= F.col("n"))).cast("long"))
    domains = materialise(of.groupBy("domain").agg(((F.sum("bad") + K * BASE) / (F.count(F.lit(1)) + K)).alias("of_domain")), "url-domains")
    hosts = materialise(named.join(domains, "domain").groupBy("host").agg(smooth(F.first("of_domain")).alias("of_host")), "url-hosts")
    purities = materialise(named.join(hosts, "host").groupBy("host", "template").agg(smooth(F.first("of_host")).alias("purity")), "url-purities")
    judged = materialise(named.select("host", "lexical", "template").join(purities, ["host", "template"]), "url-judged")
    discard(counts, domains, hosts, purities)
    return rows.join(judged, ["host", "lexical"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"),
        "template", F.round("purity", 6).alias("purity"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
