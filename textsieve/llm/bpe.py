"""Byte-level BPE encoding and decoding by two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a
vocabulary entry is one probe and one comparison. Tier two merges the bytes of
any other pre-token: a linked list of parts and a heap of adjacent pairs by
(rank, place), so a pre-token of n bytes costs n log n and not n squared. Each
worker remembers the pre-tokens it has met, about twice MEMO of them at most,
within a long text too. Decoding copies the bytes of all ids of a batch at once.

The vocabulary (a file of "base64 rank" lines) is read on the driver and
broadcast; its size is fixed by the tokenizer. Texts go through one Arrow pass
with no shuffle, in output batches of about CHUNK characters.

Defined cases: a null text is empty and gives no ids; special-token strings are
ordinary text; other columns pass through; existing columns ids and decoded are
replaced.
"""

from __future__ import annotations

import base64
import re
from array import array
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import fields, map_arrow

MEMO = 400_000
CHUNK = 4_000_000
#: Pre-tokens of a long text that are looked up at a time.
PIECES = 200_000


# Letters and numbers of the pattern engine used here that Unicode had
# not yet assigned in the version of the engine whose ids count; there they are neither.
NEWER = """558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 A7F1-A7F1
AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DE0-11DE9 11DF1-11DF1 1246F-1246F 12475-1247F
12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
NEWER = re.compile("[" + "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in (r.split("-") for r in NEWER.split())) + "]")


class PerfectHash:
    """Maps n distinct byte strings to 0..n-1 and anything else to some slot or None.

    Level by level: keys alone at their place in a bit array of twice their
    number stay there, those that collide go to the next level, whose size is odd
    and another, so that its remainders are new. A key's index is the rank of its
    bit.
    """

    def __init__(self, keys: list[bytes]):
        left = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(left)) != len(left):
            raise ValueError("two keys have one 64-bit hash")
        self.levels, base = [], 0
        while left:
            size = 2 * len(left) + 1
            while any(size == taken for taken, _ in self.levels):
                size += 2
            at = np.array([h % size for h in left])
            alone = np.bincount(at, minlength=size) == 1
            rank = np.where(alone, base + np.cumsum(alone) - 1, -1)
            self.levels.append((size, array("i", rank.tolist())))
            base += int(alone.sum())
            left = [h for h, ok in zip(left, alone[at].tolist()) if not ok]

    def slot(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        for size, rank in self.levels:
            if (r := rank[h % size]) >= 0:
                return r
        return None


class Tokenizer:
    """Ranks, the perfect hash over them, and the pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.hash = pattern, PerfectHash(list(ranks))
        self.slots: list = [None] * len(ranks)
        for k, r in ranks.items():
            self.slots[self.hash.slot(k)] = (k, r)
        # The bytes of every id, one after the other, and where each id's begin.
        self.joined = np.frombuffer(b"".join(k for _, k in sorted((r, k) for k, r in ranks.items())), dtype=np.uint8)
        sizes = np.zeros(max(ranks.values(), default=-1) + 2, dtype=np.int64)
        sizes[[r + 1 for r in ranks.values()]] = [len(k) for k in ranks]
        self.at = np.cumsum(sizes)
        self._ready = self.pairs = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None, "pairs": None}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Tokenizer:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return cls(ranks, pattern)

    def rank(self, piece: bytes) -> int | None:
        """Tier one."""
        s = self.hash.slot(piece)
        if s is None or self.slots[s][0] != piece:
            return None
        return self.slots[s][1]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Tier two. A heap entry is rank and place in one integer; pairs are found by their two ids."""
        n, pairs = len(piece), self.pairs
        ids = [self.byte_ids[b] for b in piece]
        end = list(range(1, n + 1))  # where the part that starts here ends
        back = list(range(-1, n - 1))
        found = [pairs.get(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]  # rank of a part with the next; -1: none, or gone
        found.append(-1)
        heap = [r << 32 | i for i, r in enumerate(found) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            if found[i] != r:
                continue  # one of its parts has changed since
            j = end[i]
            ids[i], k, found[j] = r, end[j], -1
            end[i] = k
            if k < n:
                back[k] = i
                found[i] = q = pairs.get(r << 32 | ids[k], -1)
                if q >= 0:
                    heappush(heap, q << 32 | i)
            else:
                found[i] = -1
            b = back[i]
            if b >= 0:
                found[b] = q = pairs.get(ids[b] << 32 | r, -1)
                if q >= 0:
                    heappush(heap, q << 32 | b)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = end[i]
        return tuple(out)

    def _start(self):
        import regex

        ranks = dict(self.slots)
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        # Every way to put a token together from two tokens.
        self.pairs = {a << 32 | b: r for k, r in ranks.items() for i in range(1, len(k)) if (a := ranks.get(k[:i])) is not None and (b := ranks.get(k[i:])) is not None}
        tok = self

        class Memo(dict):
            """Pre-tokens met; those of the generation before are looked up once more."""

            old: dict = {}

            def __missing__(self, word):
                out = self.old.get(word)
                if out is None:
                    piece = word.encode("utf-8")
                    r = tok.rank(piece)
                    out = array("i", (r,) if r is not None else tok.merge(piece)).tobytes()
                self[word] = out
                return out

            def turn(self):
                self.old = dict(self)
                self.clear()

        pattern = regex.compile(self.pattern)

        def pieces(text):
            if text.isascii() or not NEWER.search(text):
                return pattern.findall(text) if len(text) <= CHUNK else (m.group() for m in pattern.finditer(text))
            # Any other sign stands in for them while the pattern looks.
            return (text[m.start() : m.end()] for m in pattern.finditer(NEWER.sub("\u2020", text)))

        self._ready = (pieces, Memo())
        return self._ready

    def packed(self, text: str) -> bytes:
        """The ids as 32-bit integers, one after the other."""
        find, memo = self._ready or self._start()
        found, out = find(text), []
        if isinstance(found, list) and len(found) <= PIECES:
            if len(memo) > MEMO:
                memo.turn()
            return b"".join(map(memo.__getitem__, found))
        found = iter(found)
        while part := list(islice(found, PIECES)):
            if len(memo) > MEMO:
                memo.turn()
            out.append(b"".join(map(memo.__getitem__, part)))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()

    def decode(self, ids) -> bytes:
        return self.bytes_of(np.asarray(ids, dtype=np.int64))[0].tobytes()

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's end."""
        size = self.at[ids + 1] - self.at[ids]
        parts = [np.empty(0, dtype=np.uint8)]
        for a in range(0, len(ids), PIECES):
            n = size[a : a + PIECES]
            ends = np.cumsum(n)
            # Within one id places go up by one; between two they jump.
            place = np.repeat(self.at[ids[a : a + PIECES]] - (ends - n), n)
            place += np.arange(len(place))
            parts.append(self.joined[place])
        return np.concatenate(parts), np.cumsum(size)


def _apply(df: DataFrame, tok: Tokenizer, in_col: str, new: list[tuple[str, str]], work) -> DataFrame:
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(tok)
    keep = [c for c in df.columns if c not in {n for n, _ in new}]
    src = df.select(*keep) if in_col in keep else df.select(*keep, F.col(in_col))
    schema = fields(df, keep, ", ".join(f"`{n}` {t}" for n, t in new))

    def run(batches):
        t = shared.value
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(in_col))
            size = batch.nbytes // max(1, batch.num_rows)
            step = max(1, CHUNK // max(1, size))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + work(t, col.slice(a, step)), names=keep + [n for n, _ in new])

    return map_arrow(src, run, schema)


def _ids(rows: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))


def _bytes(tok: Tokenizer, rows: list[bytes]) -> pa.Array:
    """The bytes of rows of ids, about CHUNK ids at a time."""
    parts, a = [], 0
    while a < len(rows):
        b, n = a, 0
        while b < len(rows) and (b == a or n + len(rows[b]) // 4 <= CHUNK):
            n += len(rows[b]) // 4
            b += 1
        data, ends = tok.bytes_of(np.frombuffer(b"".join(rows[a:b]), dtype=np.int32).astype(np.int64))
        cut = np.concatenate(([0], np.cumsum([len(x) // 4 for x in rows[a:b]])))
        offsets = np.concatenate(([0], ends))[cut].astype(np.int32)
        parts.append(pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
        a = b
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def encode(df: DataFrame, tok: Tokenizer, text_col: str = "text") -> DataFrame:
    """df with ids."""
    return _apply(df, tok, text_col, [("ids", "array<int>")], lambda t, col: [_ids([t.packed(x or "") for x in col.to_pylist()])])


def decode(df: DataFrame, tok: Tokenizer, ids_col: str = "ids") -> DataFrame:
    """df with decoded (binary), from ids."""
    return _apply(df, tok, ids_col, [("decoded", "binary")], lambda t, col: [_bytes(t, [np.asarray(x or (), dtype=np.int32).tobytes() for x in col.to_pylist()])])


def round_trip(df: DataFrame, tok: Tokenizer, text_col: str = "text") -> DataFrame:
    """df with ids and decoded, in one pass."""

    def work(t, col):
        ids = [t.packed(x or "") for x in col.to_pylist()]
        return [_ids(ids), _bytes(t, ids)]

    return _apply(df, tok, text_col, [("ids", "array<int>"), ("decoded", "binary")], work)


def default_tokenizer() -> Tokenizer:
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def digests(df: DataFrame) -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(joined, "UTF-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(round_trip(docs, default_tokenizer()).drop("text"))
