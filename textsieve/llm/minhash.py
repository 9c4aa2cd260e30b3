r"""MinHash near-duplicate groups.

1. One Arrow pass turns each text into its set of word shingles (64-bit
   hashes), and that into MINIMA minima of multiply-shift universal hashes; the
   first of them are banded, a byte of each is the signature.
2. Documents with one set are one class; from here on a class is one node.
3. Banding: classes that share a band are a bucket. Each member is paired with
   the bucket's smallest node, so a bucket of m gives m - 1 pairs.
4. Pairs whose signatures agree well enough are verified on full sets. A hot
   node's partners are salted over tasks, each with one copy of its text.
5. Connected components by alternating large-star and small-star.
6. Buckets that still hold several components are searched for links that the
   stars missed. Their members are dealt into blocks; those outside the bucket's
   largest component visit every block. Signatures meet first; members whose
   signatures agree with one of another component meet again with their texts,
   and there pairs are verified in place; only links leave. After that every pair
   of a bucket is in one component, verified, or below what a linked pair's
   signatures show. Visitors come in groups, so a meeting has about BLOCK members
   and as many visitors; a bucket of m members with v visitors costs about
   m + 2 * v * m / BLOCK rows.

The number of bands follows the threshold: a pair right at it shares no band
with chance under one in a million.

Defined cases: a null text, or one without words, links with nothing and is its
own component; with fewer words than a shingle has, the whole sequence is the one
shingle; a null doc_id takes part but is never a component's id unless it has
no other; rows equal in text are one class. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import KEY, fields, join_counted, join_on_key, map_arrow, staged, with_row_key

WORDS, PERCENT = 5, 80
ROWS, MISS = 4, 1e-6
MINIMA = 200
#: Signature agreement this many standard deviations below the threshold still counts.
SIGMAS = 5
BLOCK, BLOCK_BYTES, SALT = 256, 8_000_000, 64
CHUNK = 60_000
#: Rounds of the stars; they halve the height of a component, so there are far fewer.
MAX_ROUNDS = 100


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def least_agreement(percent: int) -> int:
    """Signature bytes of a pair right at the threshold that agree, less SIGMAS deviations."""
    p = percent / 100 + (1 - percent / 100) / 256
    return math.floor(MINIMA * p - SIGMAS * math.sqrt(MINIMA * p * (1 - p)))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240517)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


MULTIPLY, ADD = _constants(MINIMA)
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes. bytes.lower() and split() know ASCII only, as the word rule does."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(k, len(words))
    out = h[: len(h) - k + 1] * STEP
    for i in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * STEP + h[i : len(h) - k + 1 + i]
    out ^= out >> np.uint64(32)
    return np.unique(out * STEP + np.uint64(k))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of MINIMA 32-bit minima for each non-empty set."""
    out = np.empty((len(sets), MINIMA), dtype=np.uint32)
    a = 0
    while a < len(sets):
        b, size = a + 1, len(sets[a])
        while b < len(sets) and size + len(sets[b]) <= CHUNK:
            size += len(sets[b])
            b += 1
        part = np.concatenate(sets[a:b])
        starts = np.cumsum([0] + [len(s) for s in sets[a : b - 1]])
        for i in range(MINIMA):
            out[a:b, i] = np.minimum.reduceat(part * MULTIPLY[i] + ADD[i], starts) >> np.uint64(32)
        a = b
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, n_bands: int) -> DataFrame:
    """Rows (doc_id, h1, h2, n, c1, c2, bands, signature); the last four are null for empty sets."""

    def run(batches):
        for batch in batches:
            texts = batch.column(3)
            size = max(1, batch.nbytes // max(1, batch.num_rows))
            step = max(1, 8_000_000 // size)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sets = [shingle_set(t, k) for t in texts.slice(at, step).to_pylist()]
                full = [s for s in sets if len(s)]
                m = minima(full) if full else np.empty((0, MINIMA), dtype=np.uint32)
                # A band's key: its minima and its number.
                keys = np.zeros((len(full), n_bands), dtype=np.uint64)
                for r in range(ROWS):
                    keys = (keys ^ (keys >> np.uint64(31))) * STEP + m[:, r : n_bands * ROWS : ROWS]
                keys = (keys + np.arange(n_bands, dtype=np.uint64)) * MULTIPLY[0]
                keys ^= keys >> np.uint64(32)
                keys = iter((keys * STEP).view(np.int64).tolist())
                low = iter((m & np.uint32(255)).astype(np.uint8))
                bands, sigs, c1, c2 = [], [], [], []
                for s in sets:
                    if len(s):
                        d = xxhash.xxh3_128_digest(s.tobytes())
                        bands.append(next(keys))
                        sigs.append(next(low).tobytes())
                        c1.append(int.from_bytes(d[:8], "big", signed=True))
                        c2.append(int.from_bytes(d[8:], "big", signed=True))
                    else:
                        for x in (bands, sigs, c1, c2):
                            x.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    names=["doc_id", "h1", "h2", "n", "c1", "c2", "bands", "signature"],
                )

    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(7), F.col(text_col)).alias("h2"), F.col(text_col).alias("text"))
    return map_arrow(src, run, fields(src, ["doc_id", "h1", "h2"], "n long, c1 long, c2 long, bands array<long>, signature binary"))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of edges (a, b), a > b, by alternating large-star and small-star.

    component is the smallest node reachable. Every pass is written to the
    shared folder; the loop ends when a pass changes nothing. A node with very
    many edges is joined to its smallest neighbour without moving its edges.
    """
    edges, last = staged(edges.distinct(), "edges"), None
    for _ in range(MAX_ROUNDS):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "low")
        large = join_counted(both.where(F.col("v") > F.col("u")), low, ["u"], "n").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "large")
        low = staged(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        small = join_counted(large, low, ["a"], "n").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = staged(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = state
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")


def agreeing(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in least bytes or more."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, MINIMA) for i in (2, 3))
                keep = pa.array((x == y).sum(axis=1) >= least)
                yield batch.select(["a", "b"]).filter(keep)

    sig = nodes.select("node", "signature")
    lows = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("m")).join(sig.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
    rows = join_counted(pairs.join(sig.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a"), staged(lows, "lows"), ["b"], "m")
    return map_arrow(rows.select("a", "b", "sa", "sb"), run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full sets.

    Rows of one b (and salt) reach one task with b's text first; the task holds
    two sets at a time.
    """
    fan = staged(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("m"), F.floor((F.count(F.lit(1)) - 1) / SALT + 1).cast("int").alias("salts")), "fan")
    left = join_counted(pairs, fan, ["b"], "m").select("b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), "a").join(texts.withColumnRenamed("node", "a"), "a").select("b", "salt", "a", "text")
    heads = fan.join(texts.withColumnRenamed("node", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"), "text")
    rows = heads.unionByName(left).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def run(batches):
        base = None
        for batch in batches:
            found_a, found_b = [], []
            for b, a, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if a is None:
                    base = shingle_set(text.as_py(), k)
                    continue
                if linked(shingle_set(text.as_py(), k), base, percent):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return map_arrow(rows, run, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def meeting(rows: DataFrame, payload: list[str]) -> DataFrame:
    """Rows (key, t, g, side, s, band, node, component, away, payload) in order of key, block t, group g, side, node.

    rows: key, blocks, groups, band, node, component, away. Side 0 are the members of
    block t, side 1 those away from the largest component, of block s and group g,
    which visit it.
    """
    dealt = rows.withColumns({"s": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), "own": F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups")).cast("int")})
    cols = ["s", "band", "node", "component", "away", *payload]
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = dealt.select("key", F.col("s").alias("t"), all_of("groups").alias("g"), F.lit(0).alias("side"), *cols)
    visits = dealt.where("away").select("key", all_of("blocks").alias("t"), F.col("own").alias("g"), F.lit(1).alias("side"), *cols)
    return home.unionByName(visits).repartition("key", "t", "g").sortWithinPartitions("key", "t", "g", "side", "node")


def _runs(batch: pa.RecordBatch):
    """((key, t, g), side, first row, row after the last) of a batch in order."""
    if batch.num_rows:
        ids = [batch.column(i).to_numpy() for i in range(4)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in ids], axis=0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            yield tuple(int(c[a]) for c in ids[:3]), ids[3][a], a, b


class Members:
    """Some members of a bucket in arrays."""

    def __init__(self, batch: pa.RecordBatch, a: int, b: int):
        part = batch.slice(a, b - a)
        self.s, self.band, self.node, self.component = (part.column(i).to_numpy().copy() for i in range(4, 8))
        self.away = np.array(part.column(8).to_pylist())
        self.signature = np.frombuffer(b"".join(part.column(9).to_pylist()), dtype=np.uint8).reshape(-1, MINIMA)
        self.bands = np.array(part.column(10).to_pylist())
        self.texts = part.column(11).to_pylist() if batch.num_columns > 11 else None
        self.sets: dict[int, np.ndarray] = {}

    def shingles(self, i: int, k: int) -> np.ndarray:
        if i not in self.sets:
            self.sets[i] = shingle_set(self.texts[i], k)
        return self.sets[i]


def agree(home: Members, guests: Members, j: int, t: int, least: int) -> np.ndarray:
    """Members of block t that guest j is held against here: of another component, alike enough, in the first bucket they share."""
    once = ~home.away | (guests.s[j] > t) | ((guests.s[j] == t) & (guests.node[j] > home.node))
    other = np.flatnonzero(once & (home.component != guests.component[j]))
    other = other[(home.signature[other] == guests.signature[j]).sum(axis=1) >= least]
    return other[(home.bands[other] == guests.bands[j]).argmax(axis=1) == guests.band[j]] if len(other) else other


def met(rows: DataFrame, visit, names: list[str]) -> DataFrame:
    """Rows of longs that visit(key, t, members of the block, guests) gives; the members are held, guests come in batches."""

    def run(batches):
        at, home = None, []
        for batch in batches:
            out: set[tuple] = set()
            for place, side, a, b in _runs(batch):
                if place != at:
                    at, home = place, []
                part = Members(batch, a, b)
                if side == 0:
                    home.append(part)
                else:
                    for own in home:
                        out.update(visit(*place[:2], own, part))
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return map_arrow(rows, run, ", ".join(f"{n} long" for n in names)).distinct()


def blocks_of(n):
    return F.ceil(n / BLOCK).cast("int")


def missed_links(members: DataFrame, nodes: DataFrame, links: DataFrame, texts: DataFrame, k: int, percent: int, least: int) -> DataFrame:
    """Links (a, b) between different components that share a bucket; a link joins its two components for the rest of a meeting."""
    rows = members.join(links, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("component"))
    per = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    open_ = staged(per.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("home"), F.sum("n").alias("m"), F.max("n").alias("most"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds"), "open")
    rows = join_counted(rows, open_, ["key"], "m").select("key", "band", "node", "component", (F.col("component") != F.col("home")).alias("away"), blocks_of(F.col("m")).alias("blocks"), blocks_of(F.col("m") - F.col("most")).alias("groups"))
    rows = staged(rows.join(nodes.select("node", "signature", "bands"), "node"), "open-members")

    def alike(key, t, home, guests):
        for j in range(len(guests.node)):
            other = agree(home, guests, j, t, least)
            if len(other):
                yield key, int(guests.node[j])
                yield from ((key, int(n)) for n in home.node[other])

    active = staged(met(meeting(rows, ["signature", "bands"]), alike, ["key", "node"]), "alike")
    rows = rows.drop("blocks", "groups").join(active, ["key", "node"])
    bytes_ = rows.select("key", "node", "away").join(texts.select("node", F.octet_length("text").alias("bytes")), "node")
    sizes = bytes_.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("bytes"), F.count_if("away").alias("guests"))
    sizes = staged(sizes.select("key", "m", F.greatest(blocks_of(F.col("m")), F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int")).alias("blocks"), F.greatest(blocks_of(F.col("guests")), F.lit(1)).alias("groups")), "alike-sizes")
    rows = join_counted(rows, sizes, ["key"], "m").join(texts, "node")

    def verify(key, t, home, guests):
        for j in range(len(guests.node)):
            for i in agree(home, guests, j, t, least).tolist():
                old, new = home.component[i], guests.component[j]
                if old != new and linked(home.shingles(i, k), guests.shingles(j, k), percent):
                    yield int(max(home.node[i], guests.node[j])), int(min(home.node[i], guests.node[j]))
                    home.component[home.component == new] = old
                    guests.component[guests.component == new] = old
            guests.sets.pop(j, None)

    return met(meeting(rows, ["signature", "bands", "text"]), verify, ["a", "b"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, keys: bool = False) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each document; keys: with h1 and h2, hashes of its text."""
    n_bands, least = bands_for(percent), least_agreement(percent)
    rows = staged(sketches(docs, id_col, text_col, words, n_bands), "sketches")
    full = rows.where(F.col("n") > 0)
    classes = full.groupBy("c1", "c2").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("h1", "h2")).alias("text_key"), F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("copies"))
    nodes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = staged(join_counted(banded, staged(shared, "shared"), ["key"], "m").drop("m"), "buckets")
    pairs = members.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    alike = staged(agreeing(pairs, nodes, least), "pairs")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("text_key.h1").alias("h1"), F.col("text_key.h2").alias("h2"), "copies")
    source = docs.select(F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(7), F.col(text_col)).alias("h2"), F.col(text_col).alias("text"))
    # Copies of one text give one row.
    texts = staged(join_counted(source, staged(wanted, "wanted"), ["h1", "h2"], "copies", cold="merge").dropDuplicates(["node"]).select("node", "text"), "texts")
    edges = staged(verified(alike, texts, words, percent), "edges")
    links = components(edges)
    more = staged(missed_links(members, nodes, links, texts, words, percent, least), "edges")
    if not more.isEmpty():
        links = components(edges.unionByName(more))
    placed = nodes.select("node", "c1", "c2", "least_id", "copies").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    placed = staged(placed.join(ids, "component").select("c1", "c2", "component_id", "copies"), "placed")
    out = join_counted(rows.select("doc_id", "n", "c1", "c2", "h1", "h2"), placed, ["c1", "c2"], "copies", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *["h1", "h2"] * keys).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group, that with the smallest id; of rows equal in id and text, one."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, words=words, percent=percent, keys=True)
    kept = found.where("kept").select(F.col("doc_id").alias(KEY[0]), F.col("h1").alias(KEY[1]), F.col("h2").alias(KEY[2])).distinct()
    return join_on_key(with_row_key(docs, id_col, text_col), kept.withColumn("__ts_in", F.lit(True)), "inner").dropDuplicates(KEY).drop(*KEY, "__ts_in")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, words=3, percent=85)
