r"""Quality rules with cross-document line frequency.

Base rules look at one text. The cross-document rule hashes normalised lines
and counts, per host, the distinct documents (rows) that carry each, copies too.
A line above both limits of its host (MIN_DOCS documents, and MAX_SHARE of the
host's documents, or ENOUGH_DOCS of them) is removed, and a document with too
little left is depleted and rejected. DataFrame functions only.

One pass over the texts writes the measures and line hashes to a staged table
with a row number; frequencies and removals work on that, and a line that very
many rows carry is one partial count in each task.

Words are runs of [^\x20\x09-\x0D]. Defined cases: a null text has no words
and fails; a null host is a host of its own; repeated rows are measured each
for itself; empty tables give none. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line_dedup import normalised
from .stage import KEY, join_counted, join_on_key, staged, with_row_key

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
WINDOW = 5
#: A line goes when more than MIN_DOCS documents of one host carry it, and more than the share or ENOUGH_DOCS.
MIN_DOCS, MAX_SHARE, ENOUGH_DOCS = 20, 0.02, 10_000
#: A document with removed lines needs this much left. The base rule's ten words would reject seven times as many
#: documents that are labelled good, all of them short texts beside one common line (README has the figures).
LEFT_WORDS, LEFT_PERCENT = 3, 20
SPACE = r"[\x20\x09-\x0D]+"


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and __ts_lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__ts_words", F.filter(F.split(text, SPACE, -1), lambda w: w != ""))
    # Words to 64-bit hashes, those to hashes of two, four and five in a row; of a
    # text's n windows two differing ones agree with chance n*n/2^65.
    both = lambda x, y: F.zip_with(x, y, lambda a, b: F.xxhash64(a, b))
    from_ = lambda c, k: F.slice(c, k, F.greatest(F.size(c) - (k - 1), F.lit(0)))
    out = out.withColumn("__ts_h1", F.transform("__ts_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("__ts_h2", both("__ts_h1", from_("__ts_h1", 2)))
    out = out.withColumn("__ts_h4", both("__ts_h2", from_("__ts_h2", 3)))
    out = out.withColumn("__ts_h5", both("__ts_h4", from_("__ts_h1", 5)))
    out = out.withColumn("__ts_win", F.slice("__ts_h5", 1, F.greatest(F.size("__ts_h5") - (WINDOW - 1), F.lit(0))))
    out = out.withColumn("__ts_twice", F.size(F.array_distinct("__ts_win")) < F.size("__ts_win"))
    ordered = F.when(F.col("__ts_twice"), F.sort_array(F.transform("__ts_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("__ts_ord", ordered)
    near = lambda k, x, i: F.coalesce(F.get("__ts_ord", i + k)["h"] == x["h"], F.lit(False))
    found = F.filter("__ts_ord", lambda x, i: near(-1, x, i) | near(1, x, i))
    out = out.withColumn("__ts_at", F.sort_array(F.transform(found, lambda x: x["i"])))
    # A repeated window covers up to the next repeated window, WINDOW words at most.
    steps = F.transform("__ts_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__ts_at", i + 1) - p, F.lit(WINDOW))))
    covered = F.when(F.col("__ts_twice"), F.aggregate(steps, F.lit(0), lambda a, x: a + x)).otherwise(0)
    out = out.withColumn("__ts_full", F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("__ts_norm", F.transform("__ts_full", normalised))
    # A normalised line has one space between words.
    lines = F.transform("__ts_norm", lambda s: F.struct(F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(7), s).alias("h2"), (F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1).alias("n")))
    return out.withColumns({
        "n_words": F.size("__ts_words").cast("long"),
        "word_chars": F.length(F.array_join("__ts_words", "")).cast("long"),
        "n_symbols": (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("long"),
        "n_dup_lines": (F.size("__ts_full") - F.size(F.array_distinct("__ts_full"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "__ts_lines": lines,
    }).drop("__ts_words", "__ts_h1", "__ts_h2", "__ts_h4", "__ts_h5", "__ts_win", "__ts_twice", "__ts_ord", "__ts_at", "__ts_full", "__ts_norm")


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, enough: int = ENOUGH_DOCS) -> DataFrame:
    """Rows (host, h1, h2, rows) of the lines above the limits, and how many rows of lines they are. rows: row, host, __ts_lines."""
    hosts = rows.where(F.size("__ts_lines") > 0).groupBy("host").agg(F.count(F.lit(1)).alias("all_docs"))
    lines = rows.select("row", "host", F.inline("__ts_lines"))
    docs = lines.groupBy("host", "h1", "h2", "row").agg(F.count(F.lit(1)).alias("rows")).groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.sum("rows").alias("rows"))
    above = (F.col("docs") > max_share * F.col("all_docs")) | (F.col("docs") > enough)
    return docs.where(F.col("docs") > min_docs).join(hosts, "host").where(above).select("host", "h1", "h2", "rows")


def _host(host_col: str):
    return F.coalesce(F.col(host_col).cast("string"), F.lit("\x00null"))


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _host(host_col).alias("host"))
    rows = measures(base).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), F.col("text")), "row": F.monotonically_increasing_id()}).drop("text")
    return staged(rows, "quality")


def _verdict(words, repeated, removed):
    """Whether the base rules fail, and whether a document is kept."""
    left = words - removed
    failed = (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)
    depleted = (removed > 0) & ((left < LEFT_WORDS) | (100 * left < LEFT_PERCENT * words))
    return failed, ~failed & ~depleted


def cleaned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs with the frequent lines of their host out of text, and n_removed_words and kept, which follow from it.

    A row is found again by its id, host and text; rows equal in these get equal results.
    """
    rows = _measured(docs, id_col, text_col, host_col).withColumnsRenamed({"doc_id": "__ts_id", "t1": "__ts_h1", "t2": "__ts_h2"})
    lines = rows.select("__ts_id", "host", "__ts_h1", "__ts_h2", F.inline("__ts_lines"))
    frequent = staged(frequent_lines(rows), "frequent-lines")
    keys = [*KEY, "__ts_host"]
    gone = join_counted(lines, frequent, ["host", "h1", "h2"], "rows").withColumnRenamed("host", "__ts_host").groupBy(*keys).agg(F.collect_set(F.struct("h1", "h2")).alias("__ts_gone"))
    seen = rows.withColumnRenamed("host", "__ts_host").groupBy(*keys).agg(F.first("n_words").alias("__ts_n"), F.first("n_repeat_words").alias("__ts_r"))
    found = join_on_key(seen, gone, keys=keys)
    own = [c for c in docs.columns if c not in ("n_removed_words", "kept")]
    out = join_on_key(with_row_key(docs.select(*own).withColumn("__ts_host", _host(host_col)), id_col, text_col), found, keys=keys)
    there = lambda s: F.array_contains("__ts_gone", F.struct(F.xxhash64(normalised(s)).alias("h1"), F.xxhash64(F.lit(7), normalised(s)).alias("h2")))
    text = F.when(F.col("__ts_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(F.split(text_col, "\n", -1), lambda s: ~there(s)), "\n"))
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != ""))
    out = out.withColumns({"__ts_text": text, "__ts_removed": (F.col("__ts_n") - words).cast("long")}).select(*[F.col("__ts_text").alias(c) if c == text_col else F.col(c) for c in own], "__ts_n", "__ts_r", F.col("__ts_removed").alias("n_removed_words"))
    _, kept = _verdict(F.col("__ts_n"), F.col("__ts_r"), F.col("n_removed_words"))
    return out.withColumn("kept", kept).drop("__ts_n", "__ts_r")


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Rows (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words): the measures of cleaned, without texts."""
    rows = _measured(docs, id_col, text_col, host_col)
    lines = rows.select("row", "host", F.inline("__ts_lines"))
    frequent = staged(frequent_lines(rows), "frequent-lines")
    gone = join_counted(lines, frequent, ["host", "h1", "h2"], "rows").groupBy("row").agg(F.sum("n").alias("n_removed_words"))
    out = rows.drop("__ts_lines", "host", "t1", "t2").join(gone, "row", "left").drop("row")
    removed = F.coalesce(F.col("n_removed_words"), F.lit(0)).cast("long")
    failed, kept = _verdict(F.col("n_words"), F.col("n_repeat_words"), removed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), removed.alias("n_removed_words"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t FROM documents),
ws AS (SELECT doc_id, list_filter(string_split_regex(t, '{SPACE}'), lambda w: w <> '') AS ws FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p, len(ws) AS n FROM ws),
win AS (SELECT doc_id, p, n, w || chr(1) || lead(w, 1) OVER o || chr(1) || lead(w, 2) OVER o || chr(1) || lead(w, 3) OVER o || chr(1) || lead(w, 4) OVER o AS g
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
dup AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win WHERE p <= n - {WINDOW}) WHERE c > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, p + k AS q FROM dup, range({WINDOW}) r(k)) GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS ln FROM d),
f AS (SELECT *, lower(trim(regexp_replace(ln, '{SPACE}', ' ', 'g'))) AS norm,
  len(list_filter(string_split_regex(ln, '{SPACE}'), lambda w: w <> '')) AS nw
  FROM l WHERE regexp_matches(ln, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) - count(DISTINCT ln) AS n FROM f GROUP BY doc_id),
h AS (SELECT host, count(DISTINCT doc_id) AS n FROM f GROUP BY host),
q AS (SELECT host, norm, count(DISTINCT doc_id) AS n FROM f GROUP BY host, norm),
b AS (SELECT q.host, q.norm FROM q JOIN h USING (host) WHERE q.n > {MIN_DOCS} AND (q.n > {MAX_SHARE} * h.n OR q.n > {ENOUGH_DOCS})),
r AS (SELECT f.doc_id, sum(nw) AS n FROM f JOIN b ON f.host = b.host AND f.norm = b.norm GROUP BY f.doc_id),
m AS (SELECT d.doc_id, len(ws.ws) AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines,
  coalesce(cov.n, 0) AS n_repeat_words, coalesce(r.n, 0) AS gone
  FROM d JOIN ws USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN r USING (doc_id)),
x AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(word_chars AS bigint) AS word_chars, cast(n_symbols AS bigint) AS n_symbols,
  cast(n_dup_lines AS bigint) AS n_dup_lines, cast(n_repeat_words AS bigint) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (gone > 0 AND (n_words - gone < {LEFT_WORDS} OR 100 * (n_words - gone) < {LEFT_PERCENT} * n_words)) AS kept,
  cast(gone AS bigint) AS n_removed_words
FROM x
"""
