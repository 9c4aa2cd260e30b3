"""Toxicity by maximum-scoring segments.

Fit: for every word and word beginning, the log-odds of the documents that
have it, labelled toxic against clean, with a Dirichlet prior in proportion to
its frequency overall. A word weighs what its most significant feature weighs;
words without one weigh a small negative drift.

Score: one linear scan finds every maximal-scoring segment of a text's words.
A segment's score S becomes lambda*S - ln(K*n): lambda solves sum p e^(lambda
s) = 1 over the words of clean documents, K comes from their best segments
(Gumbel mean). A text has the best segment, and the sum of all segments beyond
chance; a logistic curve over the two, fitted on the labels, gives 0 to 1.

Labels are read only for the fit, from at most MAX_FIT labelled documents (those
with the smallest hash of the id), one row for each. Counts of these are
aggregated in Spark; the driver gets the significant features and two numbers
for each document of the fit. lambda, K and the curve are cross-fitted: each half
of the documents is measured with the weights of the other half, where both
halves have both labels. Scoring is one Arrow pass with no shuffle.

A word is a run of letters; where a script writes no spaces, as Chinese or Thai,
that is a stretch between signs, and word beginnings are its features.

Defined cases: a null or empty text has no segment and scores what the curve
gives for none; a null doc_id counts as the empty text in crc32 (held out);
labels that are null are not used, of several for one id the largest counts;
with no usable label or one class alone, every score is the share of toxic
labels (0 without labels). Columns of the result that exist are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import fields, map_arrow, staged

#: Bound of the fit: labelled documents read for it.
MAX_FIT = 20_000
#: Lengths of word beginnings that are features.
PREFIXES = (4, 5, 6, 7, 8)
PRIOR = 50.0
MIN_Z, DRIFT, MIN_DOCS = 4.0, -0.25, 3
SIGNIFICANT = 0.05
MEMO = 400_000
WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def words_of(text: str | None) -> list[str]:
    """The words of text in lower case, as many as WORD finds in text itself: a few letters grow when lowered."""
    text = text or ""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def features(word: str) -> list[str]:
    return [word] + [f"{word[:k]}~" for k in PREFIXES if len(word) > k]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end exclusive, score), in linear time.

    Candidates are held with the totals before and after them; a new one is
    joined to the last candidate whose left total is lower, as long as its
    right total is higher, and all between them with it.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    kept: list[list] = []  # start, end, left total, right total, index of the last one with a lower left total
    for i in at.tolist():
        new = [i, i + 1, total[i], total[i + 1], -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            new[4] = j
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3], -1]
            del kept[j:]
    return [(a, b, float(r - l)) for a, b, l, r, _ in kept]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)
    constant: float | None = 0.0
    _memo: dict | None = None

    def __getstate__(self):
        return self.__dict__ | {"_memo": None}

    def word_scores(self, words: list[str]) -> np.ndarray:
        if self._memo is None or len(self._memo) > MEMO:
            weights = self.weights

            class Memo(dict):
                def __missing__(self, word):
                    found = [weights[f] for f in features(word) if f in weights]
                    self[word] = out = max(found, key=lambda x: abs(x[1]))[0] + DRIFT if found else DRIFT
                    return out

            self._memo = Memo()
        return np.array(list(map(self._memo.__getitem__, words)))

    def measure(self, text: str | None) -> tuple[float, float, list, int]:
        """Best normalised score, sum of those beyond chance, segments, words."""
        words = words_of(text)
        found = segments(self.word_scores(words)) if words else []
        shift = self.log_k + math.log(max(1, len(words)))
        normal = [self.lam * s - shift for _, _, s in found]
        return max(normal, default=-shift), sum(x for x in normal if x > -math.log(SIGNIFICANT)), [(a, b, x) for (a, b, _), x in zip(found, normal)], len(words)

    def probability(self, best: float, beyond: float) -> float:
        if self.constant is not None:
            return self.constant
        a, b, c = self.curve
        x = a + b * max(-20.0, min(60.0, best)) + c * math.log1p(max(0.0, beyond))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def feature_counts(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", fold_col: str = "fold") -> DataFrame:
    """Rows (feature, fold, toxic, clean): documents that have it. Each task sends its own sums."""

    def run(batches):
        sums: dict[tuple[int, int], Counter] = {(f, y): Counter() for f in (0, 1) for y in (0, 1)}
        for batch in batches:
            for text, y, f in zip(*(c.to_pylist() for c in batch.columns)):
                sums[f, y].update({x for w in set(words_of(text)) for x in features(w)})
            if max(map(len, sums.values())) > MEMO:
                yield from flush(sums)
        yield from flush(sums)

    def flush(sums):
        for f in (0, 1):
            clean, toxic = sums[f, 0], sums[f, 1]
            names = list(clean.keys() | toxic.keys())
            for a in range(0, len(names), 50_000):
                part = names[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([f] * len(part), pa.int32()), pa.array([toxic[x] for x in part], pa.int64()), pa.array([clean[x] for x in part], pa.int64())], names=["feature", "fold", "toxic", "clean"])
        for s in sums.values():
            s.clear()

    rows = map_arrow(labelled.select(text_col, F.col(label_col).cast("int"), F.col(fold_col).cast("int")), run, "feature string, fold int, toxic long, clean long")
    return rows.groupBy("feature", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """Rows (feature, delta, z) of the features beyond MIN_Z."""
    prior = F.lit(PRIOR) * (F.col("toxic") + F.col("clean") + 1) / (n_toxic + n_clean + 2)
    yt, yc = F.col("toxic") + prior, F.col("clean") + prior
    odds = lambda y, n: F.log(y / (F.lit(n + PRIOR + 1.0) - y))
    out = counts.where(F.col("toxic") + F.col("clean") >= MIN_DOCS).select("feature", (odds(yt, n_toxic) - odds(yc, n_clean)).alias("delta"), F.sqrt(1 / yt + 1 / yc).alias("sd"))
    return out.select("feature", "delta", (F.col("delta") / F.col("sd")).alias("z")).where(F.abs("z") >= MIN_Z)


def _lambda(values: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p e^(lambda s) = 1, for a negative mean."""
    f = lambda x: float(np.sum(p * np.exp(np.minimum(x * values, 700)))) - 1
    if values.max() <= 0 or float(np.sum(p * values)) >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, max_fit: int = MAX_FIT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled rows whose id is not held out."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = usable.groupBy(id_col).agg(F.max(label_col).cast("int").alias("__ts_y")).orderBy(F.xxhash64(id_col), id_col).limit(max_fit)
    # One row for each id, whatever its texts: at most max_fit.
    rows = docs.select(F.col(id_col).alias("__ts_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.withColumnRenamed(id_col, "__ts_id")), "__ts_id")
    rows = rows.groupBy("__ts_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("__ts_y").alias("toxic"))
    rows = staged(rows.select("text", "toxic", F.pmod(F.xxhash64("__ts_id"), F.lit(2)).cast("int").alias("fold")), "toxicity-fit")
    n = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda y, folds=(0, 1): sum(n.get((f, y), 0) for f in folds)
    if not (of(0) and of(1)):
        return Model(constant=float(of(1) > 0))
    counts = staged(feature_counts(rows), "toxicity-counts")

    def weights(folds):
        mine = counts.where(F.col("fold").isin(*folds)).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        return {r["feature"]: (r["delta"], r["z"]) for r in log_odds(mine, of(1, folds), of(0, folds)).collect()}

    model = Model(weights=weights((0, 1)), constant=None)
    cross = all(n.get((f, y), 0) for f in (0, 1) for y in (0, 1))
    # What measures the documents of fold 0, and of fold 1.
    judges = [Model(weights=weights((1 - f,)), constant=None) for f in (0, 1)] if cross else [model, model]
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(judges)

    def words(batches):
        seen = Counter()
        for batch in batches:
            for text, y, f in zip(*(c.to_pylist() for c in batch.columns)):
                if not y:
                    v, k = np.unique(np.round(shared.value[f].word_scores(words_of(text)), 2), return_counts=True)
                    seen.update(dict(zip(v.tolist(), k.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.float64()), pa.array(list(seen.values()), pa.int64())], names=["s", "n"])

    hist = map_arrow(rows, words, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    s, k = np.array([r["s"] for r in hist]), np.array([r["n"] for r in hist], dtype=float)
    lam = _lambda(s, k / k.sum()) if k.sum() else 1.0
    for m in (model, *judges):
        m.lam = lam
    measured = _measured(rows, sc.broadcast(judges))
    clean = measured[(measured.toxic == 0) & (measured.n > 0)]
    # Gumbel: the mean of lambda*S is ln(K n) + 0.5772; best has ln n off already.
    log_k = float(clean.best.mean() - 0.5772) if len(clean) else 0.0
    for m in (model, *judges):
        m.log_k = log_k
    got = _measured(rows, sc.broadcast(judges))
    x = np.column_stack([np.ones(len(got)), got.best.clip(-20, 60), np.log1p(got.beyond.clip(lower=0))])
    model.curve = tuple(float(v) for v in _logistic(x, got.toxic.to_numpy(dtype=float)))
    return model


def _measured(rows: DataFrame, judges):
    """best, beyond, n and toxic of each row, in pandas; rows are those of the fit."""

    def run(batches):
        for batch in batches:
            got = [judges.value[f].measure(t) for t, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in ((0, pa.float64()), (1, pa.float64()), (3, pa.int64()))] + [batch.column(1)], names=["best", "beyond", "n", "toxic"])

    return map_arrow(rows, run, "best double, beyond double, n long, toxic int").toPandas()


def score(docs: DataFrame, model: Model, *, text_col: str = "text", passages: bool = True) -> DataFrame:
    """docs with score, predicted, best, n_segments and, on request, passages.

    A passage is a segment beyond chance: start and end in characters, and its
    normalised score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [("score", "double"), ("predicted", "int"), ("best", "double"), ("n_segments", "long")] + [("passages", "array<struct<start:int,end:int,score:double>>")] * passages
    keep = [c for c in docs.columns if c not in {n for n, _ in new}]
    out_cols = keep
    schema = fields(docs, out_cols, ", ".join(f"`{n}` {t}" for n, t in new))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    cut = -math.log(SIGNIFICANT)

    def run(batches):
        m = shared.value
        for batch in batches:
            probs, bests, counts, where = [], [], [], []
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                best, beyond, found, _ = m.measure(text)
                sure = [x for x in found if x[2] > cut]
                probs.append(m.probability(best, beyond))
                bests.append(best)
                counts.append(len(sure))
                if passages:
                    spans = [x.span() for x in WORD.finditer(text)] if sure else []
                    where.append([{"start": spans[a][0], "end": spans[b - 1][1], "score": x} for a, b, x in sure])
            new_cols = [pa.array(probs, pa.float64()), pa.array([int(p >= 0.5) for p in probs], pa.int32()), pa.array(bests, pa.float64()), pa.array(counts, pa.int64())] + [pa.array(where, kind)] * passages
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in out_cols] + new_cols, names=out_cols + [n for n, _ in new])

    return map_arrow(docs.select(*keep), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, passages=False)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "n_segments")
