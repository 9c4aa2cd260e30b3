"""Line dedup by distinct-site spread.

Each normalised line is a 128-bit hash with a HyperLogLog sketch of the sites
that carry it. Sketches are built map-side and merged by the aggregation, so a
line that a third of all rows carry costs one sketch per task. Lines whose
estimate is near the threshold are counted exactly. A line on min_sites sites
or more is cross-site boilerplate: its first occurrence (smallest doc_id, then
position) stays and the others go. DataFrame functions only.

Defined cases: a null or empty text has no lines and stays as it is; a null
site counts as one site of its own; a null doc_id sorts before all others;
lines without a non-space character are never removed; rows equal in doc_id
and text get equal results. Result columns that already exist are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import KEY, join_counted, join_on_key, staged, with_row_key

MIN_SITES = 10
LG_K = 12
LINE = ["__ts_l1", "__ts_l2"]


def normalised(line):
    """Lower case, runs of ASCII space as one space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def exploded_lines(docs: DataFrame, site_col: str, text_col: str) -> DataFrame:
    """KEY, site, position and hash of each line that has a word."""
    lines = with_row_key(docs, text_col=text_col).select(
        *KEY, F.coalesce(F.col(site_col).cast("string"), F.lit("\x00null")).alias("__ts_site"), F.posexplode(F.split(text_col, "\n", -1)).alias("__ts_pos", "__ts_line")
    )
    norm = normalised(F.col("__ts_line"))
    return lines.where(F.col("__ts_line").rlike(r"[^\x20\x09-\x0D]")).select(*KEY, "__ts_site", "__ts_pos", F.xxhash64(norm).alias(LINE[0]), F.xxhash64(F.lit(7), norm).alias(LINE[1]))


def site_sketches(lines: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """One sketch of sites, the first occurrence and the number of rows for each line hash."""
    return lines.groupBy(*LINE).agg(F.hll_sketch_agg("__ts_site", F.lit(lg_k)).alias("sites"), F.min(F.struct("__ts_id", "__ts_pos")).alias("first"), F.count(F.lit(1)).alias("n_rows"))


def merged_sketches(*tables: DataFrame) -> DataFrame:
    """Sketches of several corpora or batches, merged by aggregation."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*LINE).agg(F.hll_union_agg("sites").alias("sites"), F.min("first").alias("first"), F.sum("n_rows").alias("n_rows"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Hashes, first occurrences and numbers of rows of lines on min_sites sites or more.

    Beyond three standard errors (and one site) of the threshold the sketch
    decides; within, the exact distinct count does.
    """
    slack = max(1.0, 3 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    spread = site_sketches(lines, lg_k).select(*LINE, "first", "n_rows", F.hll_sketch_estimate("sites").alias("n"))
    spread = staged(spread.where(F.col("n") >= min_sites - slack), "spread")
    near = spread.where(F.col("n") <= min_sites + slack).select(*LINE, "n_rows")
    exact = join_counted(lines.select(*LINE, "__ts_site"), near, LINE, "n_rows").select(*LINE, "__ts_site").distinct().groupBy(*LINE).agg(F.count(F.lit(1)).alias("exact"))
    return staged(spread.join(exact, LINE, "left").where(F.coalesce(F.col("exact"), F.col("n")) >= min_sites).select(*LINE, "first", "n_rows"), "boilerplate")


def dedup_lines(docs: DataFrame, *, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """docs with cross-site boilerplate lines out of text, and n_lines, n_removed."""
    lines = staged(exploded_lines(docs, site_col, text_col), "lines")
    found = boilerplate(lines, min_sites)
    gone = F.col("first").isNotNull()
    if keep_first:
        gone &= ~(F.col("first.__ts_id").eqNullSafe(F.col("__ts_id")) & (F.col("first.__ts_pos") == F.col("__ts_pos")))
    hit = join_counted(lines.drop("__ts_site"), found, LINE, "n_rows").where(gone).select(*KEY, "__ts_pos").distinct()
    hit = hit.groupBy(*KEY).agg(F.collect_list("__ts_pos").alias("__ts_at"))
    out = join_on_key(with_row_key(docs, text_col=text_col), hit)
    parts = F.split(text_col, "\n", -1)
    at = F.array_sort("__ts_at")
    # Between two removed lines the text stays as it is: slices, not lookups.
    starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda p: p + 1))
    ends = F.concat(at, F.array(F.size(parts)))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.slice(parts, z["s"] + 1, z["e"] - z["s"])))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(parts))
    out = out.withColumns({"__ts_n": n_lines, "__ts_gone": F.coalesce(F.size("__ts_at"), F.lit(0))})
    text = F.when(F.col("__ts_at").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    cols = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in cols], F.col("__ts_n").cast("long").alias("n_lines"), F.col("__ts_gone").cast("long").alias("n_removed"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


SQL = rf"""
WITH l AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, unnest(string_split(text, chr(10))) AS ln,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
n AS (
  SELECT *, lower(trim(regexp_replace(ln, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm,
         regexp_matches(ln, '[^\x20\x09-\x0D]') AS has_word FROM l),
f AS (
  SELECT norm, min((doc_id, pos)) AS first FROM n WHERE has_word
  GROUP BY norm HAVING count(DISTINCT site) >= {MIN_SITES}),
k AS (
  SELECT n.*, f.norm IS NOT NULL AND n.has_word AND (n.doc_id, n.pos) <> f.first AS gone
  FROM n LEFT JOIN f ON n.norm = f.norm)
SELECT d.doc_id, cast(coalesce(x.n_lines, 0) AS bigint) AS n_lines, cast(coalesce(x.n_removed, 0) AS bigint) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(x.kept, '')) END AS text_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(ln, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept
  FROM k GROUP BY doc_id) x ON d.doc_id = x.doc_id
"""
