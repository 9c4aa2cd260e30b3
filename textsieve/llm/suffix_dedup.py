"""Exact substring dedup with suffix arrays.

A byte goes when a LENGTH-byte string that covers it also starts anywhere else,
in the same text or another.

1. Anchors. Among any LENGTH bytes the GRAM-byte string with the least hash is an
   anchor, so two equal strings of LENGTH bytes have the same anchor at the same
   place. An anchor's context is all bytes that a string with it can have: it
   and LENGTH - GRAM bytes on either side. Only anchors found twice matter: all
   other text is proven free of repeats.
2. Contexts found twice or more are repeated whole. The distinct contexts of one
   anchor go to one shard, the anchor itself written as one symbol.
3. Each shard has a suffix array: ranks by a few symbols, then Larsson-Sadakane
   doubling of groups not yet sorted, in numpy; Kasai's common prefixes, all
   contexts in step. Runs of suffixes with LENGTH - GRAM symbols and the anchor
   in common, from two places of the corpus, are repeats.
4. An anchor with more than HOT distinct contexts is dealt over many shards. Each
   sends digests of its strings by digest range; a range's task merges the
   shards' sorted digests by binary search and tells each shard which of its
   strings others have.
5. Repeats join back to all occurrences, and each text loses their union.

Equal texts are searched once. Defined cases: a null text is empty; texts under
LENGTH bytes lose nothing; a text repeated as a row, with LENGTH bytes or more,
goes whole (in every copy); a null doc_id is kept as null; a very long text is
searched for anchors in pieces of PIECE bytes. Result columns that exist are
replaced; any other column passes through (names that begin with __ts_ are taken).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import fields, join_counted, map_arrow, staged

LENGTH, GRAM = 400, 256
#: Bytes searched for anchors at a time.
PIECE = 4_000_000
#: Symbols in a suffix array, but for one large anchor; contexts in a shard of a hot one.
SHARD = 250_000
HOT = 1000
#: Contexts in a task: their bytes are few for the time that they take.
TASK_CONTEXTS = 20_000
TEXT = ["h1", "h2"]
#: Groups stand in order already; this sort is quick on such.
SORT = "stable"
ODD = np.uint64(0x9E3779B97F4A7C15)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * ODD


def rolling(data: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of the size symbols from each place; 0 in the last size - 1 places.

    Powers of two by doubling, then the binary digits of size put together.
    """
    piece, width, power = _mix((data.astype(np.uint64) + np.uint64(1)) * np.uint64(base)), 1, int(base) | 1
    out, done = None, 0
    while True:
        if size & width:
            # Places shift by what is already covered.
            part = piece[done:] if done else piece
            out = part.copy() if out is None else out[: len(part)] * np.uint64(power) + part
            done += width
        if done == size:
            res = np.zeros(len(data), dtype=np.uint64)
            n = len(data) - size + 1
            res[: max(0, n)] = out[: max(0, n)]
            return res
        nxt = piece * np.uint64(power)
        nxt[:-width] += piece[width:]
        piece, width, power = nxt, width * 2, power * power & ((1 << 64) - 1)


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i:i+w] for each i, by block prefixes and suffixes."""
    n = len(x)
    fill = np.full(-n % w + w, TOP if op is np.minimum else 0, dtype=np.uint64)
    rows = np.concatenate([x, fill]).reshape(-1, w)
    left = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    right = op.accumulate(rows, axis=1).ravel()
    return op(left[:n], right[w - 1 : w - 1 + n])


def find_anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts data[start:end], each of length bytes or more."""
    n, w = len(data), length - gram + 1
    h = _mix(rolling(data, gram, 0x2545F4914F6CDD1D))
    left = np.repeat(ends, ends - starts) - np.arange(n)  # bytes to the text's end
    h[left < gram] = TOP
    low = _slide(h, w, np.minimum)
    low[left < length] = 0  # no window begins here
    high = _slide(low[::-1], w, np.maximum)[::-1]
    at = np.flatnonzero((high == h) & (left >= gram))
    return at, h[at].view(np.int64)


def find_in_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """find_anchors where one long text is searched piece by piece; each piece has all windows that begin in it."""
    if len(starts) > 1 or len(data) <= PIECE:
        return find_anchors(data, starts, ends, length, gram)
    places, hashes = [], []
    for a in range(0, len(data), PIECE):
        part = data[a : a + PIECE + length - 1]
        if len(part) >= length:
            at, f = find_anchors(part, np.array([0]), np.array([len(part)]), length, gram)
            places.append(at + a)
            hashes.append(f)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (f, c, h1, h2, pos): anchor hash, context hash, text, place."""
    left = length - gram

    def run(batches):
        for batch in batches:
            texts, h1, h2 = batch.column(2), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not batch.num_rows:
                continue
            for parts in portions(texts, length):
                sizes = np.array([len(t) for _, t in parts])
                ends = np.cumsum(sizes)
                starts = ends - sizes
                blob = b"".join(t for _, t in parts)
                at, f = find_in_pieces(np.frombuffer(blob, dtype=np.uint8), starts, ends, length, gram)
                own = np.searchsorted(ends, at, side="right")
                lo, hi = np.maximum(starts[own], at - left), np.minimum(ends[own], at + length)
                c = np.fromiter((xxhash.xxh3_64_intdigest(blob[x:y]) for x, y in zip(lo.tolist(), hi.tolist())), dtype=np.uint64, count=len(at)).view(np.int64)
                row = np.array([i for i, _ in parts])[own]
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(c), pa.array(h1[row]), pa.array(h2[row]), pa.array((at - starts[own]).astype(np.int32))], names=["f", "c", "h1", "h2", "pos"])

    return map_arrow(docs.select(*TEXT, "text"), run, "f long, c long, h1 long, h2 long, pos int")


def portions(texts: pa.Array, length: int, size: int = 400_000):
    """Lists of (row, text) of texts with length bytes or more: about size bytes together, or one long text."""
    part, n = [], 0
    for i, t in enumerate(texts):
        t = t.as_py()
        if t is None or len(t) < length:
            continue
        if part and n + len(t) > size:
            yield part
            part, n = [], 0
        part.append((i, t))
        n += len(t)
    if part:
        yield part


def _packed(data: np.ndarray, bits: int, room: int) -> tuple[np.ndarray, int]:
    """The next symbols of each place as one number, the first on top, and how many; past the end zero."""
    one = np.zeros(len(data) + room, dtype=np.uint64)
    one[: len(data)] = data + 1
    powers, width = [one], 1
    while 2 * width * bits <= 63:
        nxt = powers[-1] << np.uint64(width * bits)
        nxt[:-width] |= powers[-1][width:]
        powers.append(nxt)
        width *= 2
    key = powers.pop()
    while powers:  # what still fits, by halves
        half = 1 << (len(powers) - 1)
        part = powers.pop()
        if (width + half) * bits <= 63:
            key = key << np.uint64(half * bits)
            key[:-width] |= part[width:]
            width += half
    return key, width


def suffix_array(data: np.ndarray, bits: int) -> np.ndarray:
    """Places of data in the order of their suffixes. The order is whole: Kasai's rule rests on that.

    data: symbols that with one added fit into bits.
    """
    n = len(data)
    key, h = _packed(data, bits, 8)
    key = key[:n]
    order = np.argsort(key)
    same = np.empty(n, dtype=bool)
    same[0], same[1:] = False, key[order[1:]] == key[order[:-1]]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    group = np.maximum.accumulate(np.where(same, 0, np.arange(n)))  # first slot of the group
    rank[order] = group
    while True:
        again = same.copy()
        again[:-1] |= same[1:]
        slots = np.flatnonzero(again)  # members of groups of two or more
        if not len(slots):
            return order
        at = order[slots]
        own, then = group[slots], rank[np.minimum(at + h, n)]
        turn = np.argsort(own * np.int64(n + 2) + then + 1, kind=SORT)
        at, then = at[turn], then[turn]
        order[slots] = at
        new = np.empty(len(slots), dtype=bool)
        new[0], new[1:] = True, (own[1:] != own[:-1]) | (then[1:] != then[:-1])
        same[slots] = ~new
        group[slots] = np.maximum.accumulate(np.where(new, slots, 0))
        rank[at] = group[slots]
        h *= 2


def common_prefixes(data: np.ndarray, bits: int, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cap: int) -> np.ndarray:
    """For each place its symbols in common with the one before it in order, up to cap or more.

    Kasai's rule, for all contexts in step: from one place to the next at most
    one symbol is lost, so a comparison goes on where the last one ended.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    key, width = _packed(data, bits, 16)
    out = np.zeros(n, dtype=np.int32)
    lanes = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[lanes], sizes[lanes]
    have = np.zeros(len(starts), dtype=np.int64)
    steps = [np.uint64(1 << (bits * (width - k))) for k in range(1, width)]
    for j in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -j, side="left"))  # contexts with more than j symbols
        at = starts[:live] + j
        other = before[at]
        h = np.where(other < 0, 0, np.maximum(have[:live] - 1, 0))
        limit = n - np.maximum(at, other)
        go = np.flatnonzero((other >= 0) & (h < cap) & (h < limit))
        while len(go):
            diff = key[at[go] + h[go]] ^ key[other[go] + h[go]]
            lead = np.full(len(go), width, dtype=np.int64)  # equal symbols: those on top of the difference
            some = np.flatnonzero(diff)
            if len(some):
                lead[some] = sum((diff[some] < s).astype(np.int64) for s in steps)
            h[go] = np.minimum(h[go] + lead, limit[go])
            go = go[(lead == width) & (h[go] < cap) & (h[go] < limit[go])]
        have[:live] = h
        out[at] = h
    return out


class Shard:
    """Contexts of whole anchors, or parts of hot ones, and the repeats among them.

    rows: (f, salt, salts, c, h1, h2, place, many, left, right): place is that of
    the context in its text, many says that the context occurs twice or more;
    left and right are the bytes beside the anchor. A repeated string is flank
    symbols and the anchor.
    """

    def __init__(self, rows: list, length: int, flank: int):
        self.rows, self.length, self.window = rows, length, flank + 1
        sizes = np.array([len(r[8]) + 1 + len(r[9]) for r in rows])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        data = np.frombuffer(b"".join(r[8] + b"\0" + r[9] for r in rows), dtype=np.uint8).astype(np.int64)
        names, f = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
        self.anchor = self.starts + np.array([len(r[8]) for r in rows])
        self.plain = data.copy()  # with one symbol for any anchor
        self.plain[self.anchor] = 256
        # Symbols in use, in order and without gaps, so that many fit into one number.
        used = np.zeros(256, dtype=np.int64)
        used[data] = 1
        n_used = int(used.sum())
        data = (np.cumsum(used) - 1)[data]
        data[self.anchor] = n_used + f
        bits = int(n_used + len(names)).bit_length()
        order = suffix_array(data, bits)
        new = common_prefixes(data, bits, order, self.starts, sizes, self.window)[order] < self.window
        cls = np.empty(len(data), dtype=np.int64)
        cls[order] = np.cumsum(new)  # equal where the next window symbols are, the anchor among them
        row = np.repeat(np.arange(len(rows)), sizes)
        at = np.flatnonzero(np.arange(len(data)) + self.window <= self.ends[row])
        own = row[at]
        where = _mix(np.array([r[4] for r in rows]).view(np.uint64) * ODD + np.array([r[5] for r in rows]).view(np.uint64))
        place = np.array([r[6] for r in rows])[own] + (at - self.starts[own])
        # A string's place in the corpus; two contexts of one text can hold the same one.
        who = _mix(where[own] + place.astype(np.uint64))
        many = np.array([r[7] for r in rows], dtype=bool)[own]
        kind = cls[at]
        turn = np.argsort(kind, kind="stable")
        self.at, self.own, kind, who, many = at[turn], own[turn], kind[turn], who[turn], many[turn]
        self.first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1]))) if len(kind) else np.empty(0, dtype=np.int64)
        if len(self.first):
            self.lo, self.hi = np.minimum.reduceat(who, self.first), np.maximum.reduceat(who, self.first)
            # A context that occurs twice is two places already: bounds that stay apart whatever other shards add.
            two = np.logical_or.reduceat(many, self.first)
            self.lo, self.hi = np.where(two, np.uint64(0), self.lo), np.where(two, TOP, self.hi)
        else:
            self.lo = self.hi = np.empty(0, dtype=np.uint64)
        self.flag = np.zeros(len(data), dtype=bool)
        self.flag[self.at[np.repeat(self.lo != self.hi, np.diff(np.append(self.first, len(self.at))))]] = True

    def digests(self) -> list[tuple]:
        """(f, salt, range, strings) of the hot anchors: two digests and two places for each string."""
        hot = np.array([r[2] > 1 for r in self.rows])
        if not hot.any() or not len(self.first):
            return []
        rep = self.at[self.first]
        keep = hot[self.own[self.first]]
        table = np.stack([*(rolling(self.plain, self.window, b)[rep[keep]] for b in BASES), self.lo[keep], self.hi[keep]], axis=1)
        own = self.own[self.first][keep]
        part = np.array([r[2] for r in self.rows])[own]  # as many ranges as shards
        rng = ((table[:, 0] >> np.uint64(32)) * part.astype(np.uint64)) >> np.uint64(32)
        key = np.array([(r[0], r[1]) for r in self.rows], dtype=np.int64)[own]
        turn = np.lexsort((table[:, 1], table[:, 0], rng, key[:, 1], key[:, 0]))
        table, rng, key = table[turn], rng[turn].astype(np.int64), key[turn]
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(key, axis=0) != 0).any(axis=1) | (np.diff(rng) != 0))))
        return [(int(key[a, 0]), int(key[a, 1]), int(rng[a]), table[a:b].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(table)))]

    def marks(self) -> list[tuple]:
        """(f, c, from, to) of the repeats in contexts that occur once, by their own first byte."""
        return [(r[0], r[3], a, b) for r, s, e in zip(self.rows, self.starts.tolist(), self.ends.tolist()) if not r[7] for a, b in intervals(self.flag[s:e], self.length)]


BASES = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def intervals(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of [i, i + length) over set flags."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return [(int(a), int(b) + length) for a, b in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)])]


def contexts(docs: DataFrame, wanted: DataFrame, copies: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (f, salt, salts, c, h1, h2, place, many, left, right) of the wanted occurrences."""
    flank = length - gram
    by_text = wanted.groupBy(*TEXT).agg(F.collect_list(F.struct("f", "salt", "salts", "c", "pos", "many")).alias("want"))
    by_text = staged(by_text.join(copies, TEXT, "left").withColumn("m", F.coalesce("m", F.lit(1))), "wanted")
    rows = join_counted(docs.select(*TEXT, "text"), by_text, TEXT, "m", cold="merge").dropDuplicates(TEXT)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
    names = ["f", "salt", "salts", "c", "h1", "h2", "place", "many", "left", "right"]

    def run(batches):
        for batch in batches:
            out = []
            for h1, h2, text, want in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for w in want:
                    p = w["pos"]
                    at = max(0, p - flank)
                    out.append((w["f"], w["salt"], w["salts"], w["c"], h1, h2, at, w["many"], text[at:p], text[p + gram : p + length]))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out), kinds)], names=names)

    return map_arrow(rows.select(*TEXT, "text", "want"), run, "f long, salt int, salts int, c long, h1 long, h2 long, place int, many boolean, left binary, right binary")


def shard_repeats(ctx: DataFrame, length: int, flank: int) -> DataFrame:
    """Rows (f, c, a, b) of repeats, and (f, salt, part, strings) of hot anchors' strings."""
    tasks = -(-ctx.count() // TASK_CONTEXTS) or 1
    rows = ctx.repartition(tasks, "f", "salt").sortWithinPartitions("f", "salt")

    def emit(group):
        shard = Shard(group, length, flank)
        m, d = shard.marks(), shard.digests()
        cols = list(zip(*[(f, c, a, b, None, None, None) for f, c, a, b in m], *[(f, None, None, None, s, r, t) for f, s, r, t in d])) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(list(col), t) for col, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["f", "c", "a", "b", "salt", "part", "strings"])

    def run(batches):
        group, size = [], 0
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(10))):
                if group and size >= SHARD and r[:2] != group[-1][:2]:
                    yield emit(group)
                    group, size = [], 0
                group.append(r)
                size += len(r[8]) + len(r[9]) + 1
        if group:
            yield emit(group)

    return map_arrow(rows, run, "f long, c long, a int, b int, salt int, part long, strings binary")


def merged_strings(strings: DataFrame) -> DataFrame:
    """Rows (f, salt, found): for each shard of a hot anchor, digests of strings that other shards have."""
    rows = strings.select("f", "part", "salt", "strings").repartition("f", "part").sortWithinPartitions("f", "part", "salt")

    def meet(group):
        tables = [np.frombuffer(r[3], dtype=np.uint64).reshape(-1, 4) for r in group]
        every = np.concatenate(tables)
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        first = np.flatnonzero(np.concatenate(([True], (every[1:, :2] != every[:-1, :2]).any(axis=1))))
        twice = np.minimum.reduceat(every[:, 2], first) != np.maximum.reduceat(every[:, 3], first)
        known = every[first][twice]
        out = []
        for r, t in zip(group, tables):
            # Both are in order of the first digest; equal ones stand together.
            at = np.searchsorted(known[:, 0], t[:, 0]) if len(known) else np.zeros(len(t), dtype=np.int64)
            hit = np.zeros(len(t), dtype=bool)
            while True:
                ok = at < len(known)
                ok[ok] = known[at[ok], 0] == t[ok, 0]
                ok &= ~hit
                if not ok.any():
                    break
                hit[ok] = known[at[ok], 1] == t[ok, 1]
                at = at + 1
            hit &= t[:, 2] == t[:, 3]  # the others are marked in their shard
            if hit.any():
                out.append((r[0], r[2], np.ascontiguousarray(t[hit, :2]).tobytes()))
        return out

    def run(batches):
        group = []
        for batch in batches:
            out = []
            for r in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if group and r[:2] != group[0][:2]:
                    out += meet(group)
                    group = []
                group.append(r)
            yield emit(out)
        yield emit(meet(group) if group else [])

    def emit(out):
        cols = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()))], names=["f", "salt", "found"])

    return map_arrow(rows, run, "f long, salt int, found binary")


def found_elsewhere(ctx: DataFrame, found: DataFrame, length: int, flank: int) -> DataFrame:
    """Rows (f, c, a, b): strings of hot anchors' contexts that are repeated in other shards."""
    lists = found.select("f", "salt", F.lit(None).cast("long").alias("c"), F.col("found").alias("left"), F.lit(None).cast("binary").alias("right"))
    rows = ctx.where("salts > 1 and not many").select("f", "salt", "c", "left", "right")
    rows = lists.unionByName(rows).repartition("f", "salt").sortWithinPartitions("f", "salt", F.col("c").asc_nulls_first())

    def run(batches):
        at, known = None, None
        for batch in batches:
            out = []
            for f, salt, c, left, right in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (f, salt) != at:
                    at, known = (f, salt), set()
                if c is None:
                    t = np.frombuffer(left, dtype=np.uint64).reshape(-1, 2)
                    known.update(zip(t[:, 0].tolist(), t[:, 1].tolist()))
                elif known and len(left) + len(right) >= flank:
                    data = np.frombuffer(left + b"\0" + right, dtype=np.uint8).astype(np.int64)
                    data[len(left)] = 256
                    d = [rolling(data, flank + 1, x)[: len(data) - flank].tolist() for x in BASES]
                    out += [(f, c, x, y) for x, y in intervals(np.array([p in known for p in zip(*d)]), length)]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["f", "c", "a", "b"])

    return map_arrow(rows, run, "f long, c long, a int, b int")


def repeated_spans(docs: DataFrame, copies: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (h1, h2, spans): what each distinct text loses, as (a, b) byte spans that may overlap or pass its end. docs: h1, h2, text."""
    flank = length - gram
    every = staged(anchors(docs, length, gram), "anchors-all")
    twice = every.groupBy("f").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    live = staged(join_counted(every, staged(twice, "anchors-found"), ["f"], "m").drop("m").distinct(), "anchors")
    kinds = staged(live.groupBy("f", "c").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("h1", "h2", "pos")).alias("at")), "contexts")
    mixed = kinds.groupBy("f").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    wanted = join_counted(kinds, staged(mixed.withColumn("salts", F.ceil(F.col("k") / HOT).cast("int")), "mixed"), ["f"], "k").select("f", F.pmod(F.xxhash64("c"), F.col("salts")).cast("int").alias("salt"), "salts", "c", "at.*", (F.col("m") > 1).alias("many"))
    ctx = staged(contexts(docs, wanted, copies, length, gram), "context-texts")
    found = staged(shard_repeats(ctx, length, flank), "repeats")
    marks = found.where("strings is null").select("f", "c", "a", "b")
    strings = found.where("strings is not null")
    if not strings.isEmpty():
        marks = marks.unionByName(staged(found_elsewhere(ctx, merged_strings(strings), length, flank), "repeats"))
    # By the context's first byte; those that occur twice go whole.
    whole = kinds.where("m > 1").select("f", "c", "m", F.lit(0).alias("a"), F.lit(2 * length).alias("b"))
    marked = join_counted(live, whole, ["f", "c"], "m").drop("m").unionByName(live.join(marks, ["f", "c"]))
    first = F.greatest(F.col("pos") - flank, F.lit(0))
    spans = marked.select(*TEXT, (first + F.col("a")).alias("a"), F.least(first + F.col("b"), F.col("pos") + length).alias("b"))
    return spans.distinct().groupBy(*TEXT).agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def dedup_substrings(docs: DataFrame, *, text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with kept (binary, the bytes left), n_bytes, n_removed, n_spans."""
    new = ["kept", "n_bytes", "n_removed", "n_spans"]
    cols = [c for c in docs.columns if c not in new]
    keys = {"h1": F.xxhash64(text_col), "h2": F.xxhash64(F.lit(7), F.col(text_col))}
    texts = docs.select(*[c.alias(k) for k, c in keys.items()], F.col(text_col).cast("binary").alias("text"))
    copies = staged(texts.groupBy(*TEXT).agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "copies")
    spans = repeated_spans(texts, copies, length, gram)
    lost = staged(spans.join(copies, TEXT, "full").select(*TEXT, "spans", (F.col("m") > 1).alias("copied"), F.coalesce("m", F.lit(1)).alias("m")), "lost")
    # Names that no column of docs has.
    own = {c: f"__ts_{c}" for c in [*TEXT, "spans", "copied", "m"]}
    keyed = docs.select(*cols, *[c.alias(own[k]) for k, c in keys.items()])
    rows = join_counted(keyed, lost.withColumnsRenamed(own), [own[k] for k in TEXT], own["m"], "left", cold="merge").select(*cols, own["spans"], F.coalesce(own["copied"], F.lit(False)).alias(own["copied"]))
    schema = fields(docs, cols, "kept binary, n_bytes long, n_removed long, n_spans long")
    at = cols.index(text_col)

    def run(batches):
        for batch in batches:
            step = max(1, 8_000_000 // max(1, batch.nbytes // max(1, batch.num_rows)))
            for x in range(0, batch.num_rows, step):
                part = batch.slice(x, step)
                kept, sizes, gone, runs = [], [], [], []
                for text, cut, copied in zip(*(part.column(i).to_pylist() for i in (at, len(cols), len(cols) + 1))):
                    data = (text or "").encode("utf-8")
                    if copied and len(data) >= length:
                        cut = [{"a": 0, "b": len(data)}]
                    pieces, end, n = [], 0, 0
                    for a, b in sorted((s["a"], min(s["b"], len(data))) for s in cut or ()):
                        if a > end or not n:
                            pieces.append(data[end:a])
                            n += 1
                        end = max(end, b)
                    pieces.append(data[end:])
                    kept.append(b"".join(pieces))
                    sizes.append(len(data))
                    gone.append(len(data) - len(kept[-1]))
                    runs.append(n)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(cols))] + [pa.array(kept, pa.binary())] + [pa.array(v, pa.int64()) for v in (sizes, gone, runs)], names=cols + new)

    return map_arrow(rows, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
