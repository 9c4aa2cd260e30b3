"""Sharding by extendible hashing.

Every row has a string of 120 bits: 60 of the hash of its id, then 60 of the
hash of its text. A directory over bit prefixes starts with one bucket; only a
bucket over the byte limit is split on its next bit. The split runs on sizes
of prefixes (one small row each), a level range at a time, so no task holds a
bucket's rows and the driver sees only how many buckets are left over. The
texts are read once for their sizes and once to be labelled.

The directory grows with the data. Up to BROADCAST_CELLS entries it is
broadcast; beyond that rows are shuffled to it, but for the entries with very
many rows.

Defined cases: a null text has 0 bytes, a null id hashes as the empty string;
one text larger than the limit is a shard of its own; rows equal in id and text
share all bits, so a bucket of such copies over the limit is dealt out by their
places in a written table (suffix "/file.n"), which no lost task changes; a limit
under one byte is an error. Result columns that already exist are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import join_counted, staged

LIMIT_BYTES = 1 << 20
ID_BITS, BITS, AHEAD = 60, 120, 2
#: Directory entries that are broadcast at most, of about a hundred bytes each.
BROADCAST_CELLS = 400_000


def _bits(col):
    return F.lpad(F.conv(F.substring(F.md5(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8")), 1, 15), 16, 2), ID_BITS, "0")


def _prefix(id_col: str, text_col: str, depth: int):
    """The first depth bits; the text is hashed only where the id's bits are used up."""
    if depth <= ID_BITS:
        return F.substring(_bits(F.col(id_col)), 1, depth)
    return F.concat(_bits(F.col(id_col)), F.substring(_bits(F.col(text_col)), 1, depth - ID_BITS))


def directory(docs: DataFrame, id_col: str, text_col: str, limit_bytes: int) -> DataFrame:
    """Rows (cell, depth, n_rows, shard, shard_bytes): each deepest prefix in use and its bucket.

    Each pass sums bytes by the prefix at its deepest level, sums those up to
    every shallower level not yet decided, and takes for each cell the shallowest
    level that fits.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes")
    sizes = staged(docs.select(_bits(F.col(id_col)).alias("bits"), size), "sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    done, over, lo = None, None, 0
    hi = min(ID_BITS, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + AHEAD)
    while True:
        rows = sizes if hi <= ID_BITS else docs.select(_prefix(id_col, text_col, hi).alias("bits"), size)
        if over is not None:
            rows = rows.withColumn("cell", F.substring("bits", 1, lo - 1)).join(over, "cell", "left_semi")
        cells = rows.groupBy(F.substring("bits", 1, hi).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
        cells = staged(cells, "cells")
        ups = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("d")).withColumn("p", F.expr("substring(cell, 1, d)"))
        fits = ups.groupBy("d", "p").agg(F.sum("bytes").alias("all_bytes")).where((F.col("all_bytes") <= limit_bytes) | (F.col("d") == BITS))
        best = ups.join(fits, ["d", "p"]).groupBy("cell").agg(F.min(F.struct("d", "p", "all_bytes")).alias("b"))
        found = staged(cells.join(best, "cell", "left").select("cell", F.lit(hi).alias("depth"), "n_rows", F.col("b.p").alias("shard"), F.col("b.all_bytes").alias("shard_bytes")), "directory")
        part = found.where(F.col("shard").isNotNull())
        done = part if done is None else done.unionByName(part)
        over = found.where(F.col("shard").isNull()).select("cell")
        if hi == BITS or over.isEmpty():
            return done
        lo, hi = hi + 1, min(ID_BITS if hi < ID_BITS else BITS, hi + 8)


def assign_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """docs with shard (its bit prefix; "" while one bucket holds all) and shard_bytes."""
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be one or more")
    docs = docs.drop("shard", "shard_bytes")
    table = directory(docs, id_col, text_col, limit_bytes)
    sizes = {r["depth"]: r["n"] for r in table.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each pass
    out = None
    for d in sorted(sizes) or [0]:
        at = table.where(F.col("depth") == d).select(F.col("cell").alias("__ts_cell"), F.col("n_rows").alias("__ts_rows"), "shard", "shard_bytes")
        rows = docs.withColumn("__ts_cell", _prefix(id_col, text_col, d))
        if sizes.get(d, 0) <= BROADCAST_CELLS:
            part = rows.join(F.broadcast(at), "__ts_cell")
        else:
            part = join_counted(rows, at, ["__ts_cell"], "__ts_rows", cold="merge")
        part = part.select(*docs.columns, "shard", "shard_bytes")
        out = part if out is None else out.unionByName(part)
    if table.where((F.length("shard") == BITS) & (F.col("shard_bytes") > limit_bytes) & (F.col("n_rows") > 1)).isEmpty():
        return out
    return _dealt(out, text_col, limit_bytes)


def _dealt(out: DataFrame, text_col: str, limit_bytes: int) -> DataFrame:
    """out where copies that no bit tells apart are dealt into shards within the limit."""
    own = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    copies = (F.length("shard") == BITS) & (F.col("shard_bytes") > limit_bytes) & (own < F.col("shard_bytes"))
    # A row's place: its file, and its number among the rows there. Rows of one shard are of one size.
    place = F.monotonically_increasing_id()
    per = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest(own, F.lit(1))))
    name = F.concat_ws("/", "shard", F.concat_ws(".", F.shiftright(place, 33).cast("string"), F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / per).cast("string")))
    split = staged(out.where(copies).drop("shard_bytes").withColumn("shard", name), "copies-dealt")
    sizes = split.groupBy("shard").agg(F.sum(own).alias("shard_bytes"))
    return out.where(~copies).unionByName(split.join(sizes, "shard").select(*out.columns))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder a shard, as Parquet."""
    out = assign_shards(docs, **options)
    out.repartition("shard").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(docs).select("doc_id", "shard", "shard_bytes")


SQL = f"""
WITH b AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n,
         lpad(bin(cast('0x' || substr(md5(coalesce(cast(doc_id AS varchar), '')), 1, 15) AS bigint)), 60, '0') AS bits
  FROM documents),
u AS (SELECT doc_id, n, d, substr(bits, 1, d) AS p FROM b, range(0, 61) r(d)),
s AS (SELECT d, p, sum(n) AS total FROM u GROUP BY d, p HAVING sum(n) <= {LIMIT_BYTES} OR d = 60),
m AS (SELECT u.doc_id, min(u.d) AS d FROM u JOIN s ON u.d = s.d AND u.p = s.p GROUP BY u.doc_id)
SELECT u.doc_id, u.p AS shard, cast(s.total AS bigint) AS shard_bytes
FROM m JOIN u ON m.doc_id = u.doc_id AND m.d = u.d JOIN s ON u.d = s.d AND u.p = s.p
"""
