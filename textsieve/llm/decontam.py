"""Benchmark decontamination by BM25 with block-max WAND.

The test items are the inverted index; every passage of every training text is
a query against it. Impacts are divided by the item's score against itself, so
one threshold fits items of any length and "all above threshold" is a fixed
set. A passage is two neighbouring chunks of as many words as the longest item
has, one chunk on: an item that a text holds lies whole in some passage.

Items are ordered by length and cut into blocks; a term has a maximum for each
block. For all chunks of a batch the block maxima of their terms are summed at
once; a passage whose sums stay below the threshold in every block is done,
which is what block-max WAND decides at its pivots, for all blocks in one step.
For the others WAND moves cursors over the postings and scores the items that
can reach the threshold.
Each one found is verified by the share of its words that stand in the passage
aligned: of the whole item, and of the question and of the answer (its last
sentence) where these have 2 * RUN words or more; a changed word in a shorter
one would weigh too much. Texts are searched in Arrow passes without a shuffle.

Words, document frequencies and the length of a passage are those of all items,
counted in Spark with the tokenizer of the search. The index is searched in parts
of about PART_WORDS words, one part after the other: the driver holds one, each
is broadcast, searched with in a pass, and let go; so no size grows with the
number of items, and results do not depend on the parts. A long text is searched
SEGMENT chunks at a time.

Defined cases: null and empty texts have no passage; null or empty items are
never found; items shorter than RUN words need their whole sequence; a question
of one sentence has an empty answer, which counts as present; repeated rows are
each reported; a null doc_id is reported as null. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import KEY, fields, join_on_key, map_arrow, staged, with_row_key

K1, B = 1.2, 0.75
MIN_SCORE = 0.6
MIN_OVERLAP = 0.8
RUN = 5
#: Items in a block, and blocks in an index at most.
BLOCK_ITEMS, MAX_BLOCKS = 2, 128
PART_WORDS = 400_000
#: Chunks of one text that are searched at a time, and words of all texts.
SEGMENT, GROUP_WORDS = 2048, 400_000
MEMO = 400_000
WORD = re.compile(r"[^\W_]+")


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer, the last sentence."""
    parts = [w for s in re.split(r"(?<=[.!?])\s+", text.strip()) if (w := WORD.findall(s.lower()))]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for s in parts[:-1] for w in s], parts[-1]


def common(words: list[str], other: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each of words."""
    at: dict[str, int] = {}
    for i, w in enumerate(words):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(words)) - 1
    v = full
    for w in other:
        u = v & at.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(words) - v.bit_count()


def overlaps(question: list[str], answer: list[str], passage: list[str]) -> tuple[float, float, float]:
    """Shares of the question, the answer and both that stand in passage aligned: in order, about as far apart.

    They are aligned with the stretch of passage that most words of the item point to.
    """
    words = question + answer
    if len(words) < RUN:
        there = any(passage[i : i + len(words)] == words for i in range(len(passage) - len(words) + 1))
        return (1.0,) * 3 if there else (0.0,) * 3
    slack = 2 + len(words) // 5
    places: dict[str, list[int]] = {}
    for j, w in enumerate(passage):
        places.setdefault(w, []).append(j)
    votes = np.zeros(len(words) + len(passage))
    for i, w in enumerate(words):
        for j in places.get(w, ()):
            votes[j - i + len(words)] += 1
    near = np.convolve(votes, np.ones(2 * slack + 1), "same")[: len(votes)] if len(votes) > 2 * slack else votes
    start = int(np.argmax(near + votes / len(votes) / len(votes))) - len(words)
    window = passage[max(0, start - slack) : start + len(words) + slack]
    share = lambda part: common(part, window) / len(part) if part else 1.0
    return share(question), share(answer), share(words)


def verified(question: list[str], answer: list[str], shares: tuple[float, float, float]) -> bool:
    """The whole item overlaps, and so does each part that is long enough to be judged alone."""
    return shares[2] >= MIN_OVERLAP and all(x >= MIN_OVERLAP for part, x in zip((question, answer), shares) if len(part) >= 2 * RUN)


class Index:
    """Postings with impacts, term maxima and block maxima."""

    def __init__(self, items: list[tuple], n_all: int, df_all: Counter, mean_len: float, longest: int | None = None):
        """items: (id, text) of this part; the rest describes all items. longest: words of the longest one."""
        split = [(i, *split_item(t or "")) for i, t in items]
        split = sorted((x for x in split if x[1]), key=lambda x: (len(x[1]) + len(x[2]), str(x[0])))
        self.ids = [x[0] for x in split]
        self.question, self.answer = [x[1] for x in split], [x[2] for x in split]
        self.longest = longest or max((len(q) + len(a) for _, q, a in split), default=1)
        lists: dict[str, list] = {}
        for n, (_, q, a) in enumerate(split):
            tf = Counter(q + a)
            norm = K1 * (1 - B + B * (len(q) + len(a)) / mean_len)
            raw = {t: math.log(1 + (n_all - df_all[t] + 0.5) / (df_all[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in tf.items()}
            own = sum(raw.values())
            for t, v in raw.items():
                lists.setdefault(t, []).append((n, v / own))
        self.terms = {t: i for i, t in enumerate(lists)}
        self.docs = [np.array([n for n, _ in p], dtype=np.int64) for p in lists.values()]
        self.impacts = [np.array([v for _, v in p]) for p in lists.values()]
        self.block = max(BLOCK_ITEMS, -(-len(split) // MAX_BLOCKS))
        self.n_blocks = max(1, -(-len(split) // self.block))
        self.block_max = np.zeros((len(lists) + 1, self.n_blocks), dtype=np.float32)
        for i, (d, v) in enumerate(zip(self.docs, self.impacts)):
            np.maximum.at(self.block_max[i], d // self.block, np.nextafter(v.astype(np.float32), np.float32(2)))
        self.top = self.block_max.max(axis=1)

    def wand(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """Items that score least or more for these distinct terms, by block-max WAND."""
        end = len(self.ids)
        at = [[int(self.docs[t][0]), t, 0] for t in terms]  # item at the cursor, term, place
        out = []

        def move(cur, to):
            d = self.docs[cur[1]]
            cur[2] += int(np.searchsorted(d[cur[2] :], to))
            cur[0] = int(d[cur[2]]) if cur[2] < len(d) else end

        while True:
            at = sorted(c for c in at if c[0] < end)
            total, pivot = 0.0, None
            for c in at:
                total += float(self.top[c[1]])
                if total >= least:
                    pivot = c[0]
                    break
            if pivot is None:
                return out
            upto = [c for c in at if c[0] <= pivot]
            block = pivot // self.block
            if sum(float(self.block_max[c[1], block]) for c in upto) < least:
                # No item up to the block's end, or to the next cursor, can do it.
                later = min([c[0] for c in at if c[0] > pivot], default=end)
                to = max(pivot + 1, min((block + 1) * self.block, later))
                for c in upto:
                    move(c, to)
            elif upto[0][0] == pivot:
                score = sum(float(self.impacts[c[1]][c[2]]) for c in upto)
                if score >= least:
                    out.append((pivot, score))
                for c in upto:
                    move(c, pivot + 1)
            else:
                for c in upto:
                    if c[0] < pivot:
                        move(c, pivot)

    def search(self, texts: list[str | None], memo: dict, min_score: float) -> list[list[tuple]]:
        """For each text its verified items: (item, score, question overlap, answer overlap)."""
        best: dict[tuple[int, int], tuple] = {}
        group, size = [], 0
        for owner, words in self.pieces(texts):
            if group and size + len(words) > GROUP_WORDS:
                self._search(group, memo, min_score, best)
                group, size = [], 0
            group.append((owner, words))
            size += len(words)
        if group:
            self._search(group, memo, min_score, best)
        out: list[list[tuple]] = [[] for _ in texts]
        for (i, n), v in sorted(best.items()):
            out[i].append((self.ids[n], *v))
        return out

    def pieces(self, texts: list[str | None]):
        """(text, words) of SEGMENT chunks and the one after them: the next piece begins with that one."""
        step = SEGMENT * self.longest
        for i, text in enumerate(texts):
            if text and len(text) <= step:
                if words := WORD.findall(text.lower()):
                    yield i, words
            elif text:
                found = (m.group() for m in WORD.finditer(text.lower()))
                words = list(islice(found, step + self.longest))
                while words:
                    yield i, words
                    more = list(islice(found, step))
                    words = words[step:] + more if more else []

    def _search(self, group: list[tuple[int, list[str]]], memo: dict, min_score: float, best: dict) -> None:
        words, size = [w for _, w in group], self.longest
        if len(memo) > MEMO:
            memo.clear()
        n_chunks = [-(-len(w) // size) for w in words]
        first = np.concatenate(([0], np.cumsum(n_chunks))).astype(np.int64)
        ids, chunk = [], []
        for i, w in enumerate(words):
            ids.append(np.fromiter(map(memo.__getitem__, w), dtype=np.int64, count=len(w)))
            chunk.append(first[i] + np.arange(len(w)) // size)
        ids, chunk = np.concatenate(ids), np.concatenate(chunk)
        hit = ids >= 0
        pairs = np.unique(chunk[hit] * len(self.block_max) + ids[hit])
        chunk, ids = pairs // len(self.block_max), pairs % len(self.block_max)
        starts = np.searchsorted(chunk, np.arange(first[-1]))
        # A term without postings ends each chunk's list, so that none is empty.
        ids = np.insert(ids, np.append(starts[1:], len(ids)), len(self.block_max) - 1)
        starts = starts + np.arange(first[-1])
        reach = np.zeros(first[-1], dtype=bool)
        last = np.zeros(first[-1], dtype=bool)
        last[first[1:] - 1] = True
        for b in range(0, self.n_blocks, 64):
            sums = np.add.reduceat(self.block_max[:, b : b + 64][ids], starts, axis=0)
            both = sums.copy()
            both[:-1] += np.where(last[:-1, None], 0, sums[1:])
            reach |= (both >= min_score).any(axis=1)
        at = np.flatnonzero(reach)
        for c, i in zip(at.tolist(), (np.searchsorted(first, at, side="right") - 1).tolist()):
            a = (c - int(first[i])) * size
            passage = words[i][a : a + 2 * size]
            terms = sorted({t for t in map(memo.__getitem__, passage) if t >= 0})
            # The two chunks' sums count terms of both twice; now each counts once.
            if not (self.block_max[terms].sum(axis=0) >= min_score).any():
                continue
            for n, score in self.wand(terms, min_score):
                shares = overlaps(self.question[n], self.answer[n], passage)
                if verified(self.question[n], self.answer[n], shares):
                    at_text = group[i][0]
                    best[at_text, n] = max(best.get((at_text, n), (0.0,)), (score, *shares[:2]))


class _Memo(dict):
    def __init__(self, terms):
        super().__init__()
        self.terms = terms

    def __missing__(self, word):
        self[word] = out = self.terms.get(word, -1)
        return out


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text, n, words) of the items with words: their number, and each distinct one."""

    def run(batches):
        for batch in batches:
            words = [sum(split_item(t or ""), []) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))], names=["id", "text", "n", "words"])

    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, fields(rows, ["id", "text"], "n long, words array<string>")).where("n > 0")


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """How many index parts of about PART_WORDS words there are, and the parts, one after the other, each with its terms' frequencies."""
    rows = staged(item_words(items, id_col, text_col), "items")
    n_all, total, longest = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    parts = max(1, -(-total // PART_WORDS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)))
    terms = rows.select("part", F.explode("words").alias("t"))
    counts = staged(terms.groupBy("t").agg(F.count(F.lit(1)).alias("n")), "frequencies")

    def part(p):
        found = [(r["id"], r["text"]) for r in rows.where(F.col("part") == p).select("id", "text").collect()]
        mine = terms.where(F.col("part") == p).select("t").distinct()
        df = Counter({r["t"]: r["n"] for r in counts.join(mine, "t").collect()})
        return Index(found, n_all, df, total / max(1, n_all) or 1.0, longest)

    return parts, map(part, range(parts))


def _searched(docs: DataFrame, index: Index, keep: list[str], text_col: str, item_type, min_score: float) -> tuple[DataFrame, object]:
    """The columns keep of docs with __ts_leaks, by one index; and the broadcast."""
    from pyspark.sql.pandas.types import to_arrow_type

    names = ("item_id", "score", "question_overlap", "answer_overlap")
    kind = pa.list_(pa.struct([("item_id", to_arrow_type(item_type)), *((n, pa.float64()) for n in names[1:])]))
    src = docs.select(*[F.col(c).alias(c) for c in dict.fromkeys([*keep, text_col])])
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix = shared.value
        memo = _Memo(ix.terms)
        for batch in batches:
            step = max(1, 2_000_000 // max(1, batch.nbytes // max(1, batch.num_rows)))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                at = part.schema.get_field_index
                found = ix.search(part.column(at(text_col)).to_pylist(), memo, min_score)
                rows = pa.array([[dict(zip(names, f)) for f in fs] for fs in found], kind)
                yield pa.RecordBatch.from_arrays([part.column(at(c)) for c in keep] + [rows], names=[*keep, "__ts_leaks"])

    schema = fields(src, keep, f"__ts_leaks array<struct<item_id:{item_type.simpleString()},score:double,question_overlap:double,answer_overlap:double>>")
    return map_arrow(src, run, schema), shared


def with_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", min_score: float = MIN_SCORE, columns: list[str] | None = None) -> DataFrame:
    """columns of docs (all, unless named) with leaks: the items that each row's text holds.

    A leak is (item, score, question_overlap, answer_overlap). One part is one
    pass and no join; of several each writes what it finds, which is few rows, and
    these join back by the row's id and text.
    """
    columns = [c for c in (columns or docs.columns) if c != "leaks"]
    item_type = items.schema[item_col].dataType
    n_parts, parts = indexes(items, item_col)
    if n_parts == 1:
        found, _ = _searched(docs, next(parts), columns, text_col, item_type, min_score)
        return found.withColumnRenamed("__ts_leaks", "leaks")
    keyed, leaks = with_row_key(docs, id_col, text_col), None
    for index in parts:
        found, shared = _searched(keyed, index, KEY, text_col, item_type, min_score)
        found = staged(found.where(F.size("__ts_leaks") > 0).distinct(), "leaks")
        shared.destroy()
        leaks = found if leaks is None else leaks.unionByName(found)
    leaks = staged(leaks.groupBy(*KEY).agg(F.flatten(F.collect_list("__ts_leaks")).alias("leaks")), "leaks")
    out = join_on_key(keyed.drop("leaks"), leaks)
    return out.select(*columns, F.coalesce("leaks", F.array().cast(leaks.schema["leaks"].dataType)).alias("leaks"))


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap) of verified leaks."""
    return with_leaks(docs, items, id_col=id_col, columns=[id_col], **options).select(F.col(id_col).alias("doc_id"), F.inline("leaks"))


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
