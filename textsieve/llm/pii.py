r"""Personal data by a character-level BiLSTM with a CRF, beside base patterns.

Base spans come from four fixed patterns (e-mail, IPv4, card with Luhn, phone).
The model is trained here, in numpy, from labelled spans: windows around digits
and @ of at most MAX_FIT documents, with tags from the base spans. It learns the
forms and surroundings and not the checks, so it also finds such strings that
the checks turn down.

A span of any kind has a digit or an @. Each text's stretches, the words with one
and what stands MARGIN characters around, are covered by overlapping windows;
window emissions are averaged where windows overlap, and a Viterbi pass decodes
them, so a span that crosses windows is found whole. A stretch over SEGMENT
characters is decoded in segments that overlap by LAP on either side; each gives
the tags of its own part, and spans are read from the tags of the whole stretch.
What overlaps a base span gives way to it. Texts go through one Arrow pass with
no shuffle.

Defined cases: a null text is empty and has no spans; without labelled spans in
the sample the model adds none; rows are independent, so repeated rows get equal
results. Result columns that exist are replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import fields, map_arrow

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the fit: documents sampled, and windows used.
MAX_FIT, MAX_WINDOWS = 4_000, 6_000
WIDTH, STRIDE, MARGIN = 64, 32, 24
#: Characters decoded in one go, beside LAP more on either side, multiples of STRIDE; characters decoded together.
SEGMENT, LAP, GROUP = 2048, 128, 60_000
HIDDEN, EMBED, STEPS, BATCH, RATE = 12, 12, 300, 64, 0.02
TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
ALPHABET = 100
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive runs: no start inside a run of digits can do what its first could not.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")
SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of kind), by start and kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        lo = done
        head = text[lo:at]
        local = len(head) - len(head.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if local else None
        if m:
            out.append((at - local, m.end(), 0))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if ANCHOR.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
                out.append((*m.span(), 1))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of text within MARGIN characters of a word that has a digit or @."""
    out: list[list[int]] = []
    at = 0
    while m := ANCHOR.search(text, at):
        begin = max(at, 1 + max(text.rfind(c, at, m.start()) for c in " \n\t"))
        end = SPACE.search(text, m.end())
        at = end.start() if end else len(text)
        a, b = max(0, begin - MARGIN), min(len(text), at + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def apart(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """spans that overlap none of base, which is in order of its starts."""
    starts = [x for x, _, _ in base]
    ends, last = [], 0  # the farthest end up to each
    for _, y, _ in base:
        last = max(last, y)
        ends.append(last)
    out = []
    for s in spans:
        i = bisect_left(starts, s[1])
        if not i or ends[i - 1] <= s[0]:
            out.append(s)
    return out


def codes(part: str) -> np.ndarray:
    """1..95 printable ASCII, 96 other space, 97 other letter, 98 the rest; 0 is padding."""
    cp = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.where((cp >= 32) & (cp < 127), cp - 31, np.where(cp < 32, 96, np.where(cp >= 0xC0, 97, 98)))
    return out.astype(np.int64)


def windows(n: int, stride: int = STRIDE) -> list[int]:
    """Starts of windows that cover n characters."""
    return list(range(0, max(1, n - WIDTH + STRIDE), stride))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, an LSTM in each direction, a linear layer, CRF transitions."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * (1 / np.sqrt(s[-2] if len(s) > 1 else 1))).astype(np.float32)
        self.p = {"e": f(ALPHABET, EMBED), "w": f(2, EMBED + HIDDEN, 4 * HIDDEN), "b": np.zeros((2, 1, 4 * HIDDEN), np.float32), "o": f(2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        self.p["b"][:, :, HIDDEN : 2 * HIDDEN] = 1  # forget gates open
        self.legal = np.ones((TAGS, TAGS), bool)
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            self.legal[:, inside] = False
            self.legal[[inside - 1, inside], inside] = True
        self.trained = False

    def _lstm(self, x: np.ndarray, keep: bool):
        """x: windows of codes. Both directions run as one stacked product."""
        p, (n, length) = self.p, x.shape
        both = np.stack([x, x[:, ::-1]])
        h = np.zeros((2, n, HIDDEN), np.float32)
        c = np.zeros_like(h)
        outs, saved = np.empty((length, 2, n, HIDDEN), np.float32), []
        for t in range(length):
            z = np.concatenate([p["e"][both[:, :, t]], h], axis=2)
            g = z @ p["w"] + p["b"]
            i, f, o = (_sigmoid(g[:, :, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, :, 3 * HIDDEN :])
            old, c = c, f * c + i * u
            tc = np.tanh(c)
            h = o * tc
            outs[t] = h
            if keep:
                saved.append((z, i, f, o, u, old, tc))
        states = np.concatenate([outs[:, 0], outs[::-1, 1]], axis=2).transpose(1, 0, 2)
        return states, both, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        states, _, _ = self._lstm(x, False)
        return states @ self.p["o"] + self.p["c"]

    def step(self, x: np.ndarray, y: np.ndarray):
        """Mean negative log-likelihood of tags y, and its gradients."""
        p, (n, length) = self.p, x.shape
        states, both, saved = self._lstm(x, True)
        em = (states @ p["o"] + p["c"]).astype(np.float64)
        tr = np.where(self.legal, p["t"], -1e4).astype(np.float64)
        # Forward and backward sums of the CRF.
        fwd, bwd = np.empty_like(em), np.zeros_like(em)
        fwd[:, 0] = em[:, 0]
        for t in range(1, length):
            s = fwd[:, t - 1][:, :, None] + tr
            m = s.max(axis=1)
            fwd[:, t] = m + np.log(np.exp(s - m[:, None]).sum(axis=1)) + em[:, t]
        for t in range(length - 2, -1, -1):
            s = tr + (em[:, t + 1] + bwd[:, t + 1])[:, None]
            m = s.max(axis=2)
            bwd[:, t] = m + np.log(np.exp(s - m[:, :, None]).sum(axis=2))
        top = fwd[:, -1].max(axis=1)
        z = top + np.log(np.exp(fwd[:, -1] - top[:, None]).sum(axis=1))
        rows = np.arange(n)[:, None]
        gold = em[rows, np.arange(length), y].sum(axis=1) + tr[y[:, :-1], y[:, 1:]].sum(axis=1)
        d_em = np.exp(fwd + bwd - z[:, None, None])
        pair = np.exp(fwd[:, :-1, :, None] + tr + (em[:, 1:] + bwd[:, 1:])[:, :, None] - z[:, None, None, None]).sum(axis=(0, 1))
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        d_em[rows, np.arange(length), y] -= 1
        d_em = (d_em / n).astype(np.float32)
        grads = {"t": (np.where(self.legal, pair, 0) / n).astype(np.float32), "c": d_em.sum(axis=(0, 1)), "o": np.einsum("nlh,nlt->ht", states, d_em)}
        d_states = d_em @ p["o"].T
        d_out = np.stack([d_states[:, :, :HIDDEN].transpose(1, 0, 2), d_states[:, ::-1, HIDDEN:].transpose(1, 0, 2)], axis=1)
        gw, gb, ge = np.zeros_like(p["w"]), np.zeros_like(p["b"]), np.zeros_like(p["e"])
        dh = np.zeros((2, n, HIDDEN), np.float32)
        dc = np.zeros_like(dh)
        for t in range(length - 1, -1, -1):
            zt, i, f, o, u, old, tc = saved[t]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            g = np.concatenate([dc * u * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=2)
            gw += zt.transpose(0, 2, 1) @ g
            gb += g.sum(axis=1, keepdims=True)
            dz = g @ p["w"].transpose(0, 2, 1)
            np.add.at(ge, both[:, :, t].ravel(), dz[:, :, :EMBED].reshape(-1, EMBED))
            dh, dc = dz[:, :, EMBED:], dc * f
        grads |= {"w": gw, "b": gb, "e": ge}
        return float((z - gold).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 5) -> list[float]:
        """Adam with clipped gradients, whole epochs of steps or more; returns the mean loss of each epoch."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        losses, n = [], 0
        batches = -(-len(x) // BATCH)
        epochs = max(2, -(-steps // batches))
        total = epochs * batches
        for _ in range(epochs):
            order, sums = r.permutation(len(x)), []
            for a in range(0, len(x), BATCH):
                loss, g = self.step(x[order[a : a + BATCH]], y[order[a : a + BATCH]])
                sums.append(loss)
                norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
                n += 1
                rate = RATE * (1 - 0.9 * n / total)
                for k, w in g.items():
                    w = w * min(1.0, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * w
                    v[k] = 0.999 * v[k] + 0.001 * w * w
                    self.p[k] -= rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)
            losses.append(float(np.mean(sums)))
        self.trained = True
        return losses

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        """Best tags for each row of emissions (rows, length, tags)."""
        tr = np.where(self.legal, self.p["t"], -1e4)
        n, length, _ = em.shape
        first = em[:, 0].copy()
        first[:, 2::2] -= 1e4  # nothing goes on before a text begins
        score, back = first, np.zeros((length, n, TAGS), np.int8)
        for t in range(1, length):
            s = score[:, :, None] + tr
            back[t] = s.argmax(axis=1)
            score = s.max(axis=1) + em[:, t]
        out = np.empty((n, length), np.int8)
        out[:, -1] = score.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        return out

    def find(self, parts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Spans (start, end, kind) of each part, decoded over its whole length."""
        if not self.trained or not parts:
            return [[] for _ in parts]
        tags = [np.zeros(len(p), np.int8) for p in parts]
        # (part, from, to, characters before from that are decoded with it)
        todo = [(i, a, min(len(p), a + SEGMENT), min(a, LAP)) for i, p in enumerate(parts) for a in range(0, len(p), SEGMENT)]
        texts = [parts[i][a - lap : b + LAP] for i, a, b, lap in todo]
        order = sorted(range(len(todo)), key=lambda n: len(texts[n]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(texts[order[end]]) <= GROUP:
                end += 1
            group = order[at:end]
            for n, found in zip(group, self.decode([texts[n] for n in group])):
                i, a, b, lap = todo[n]
                tags[i][a:b] = found[lap : lap + b - a]
            at = end
        return [self.read(p, t) for p, t in zip(parts, tags)]

    @staticmethod
    def read(part: str, tags: np.ndarray) -> list[tuple[int, int, int]]:
        """The spans of tags, each with a digit or @."""
        out = []
        for s in np.flatnonzero(tags % 2 == 1).tolist():
            rest = tags[s + 1 :]
            stop = np.flatnonzero(rest[:SEGMENT] != tags[s] + 1)
            e = s + 1 + (int(stop[0]) if len(stop) else len(rest[:SEGMENT]))
            while len(stop) == 0 and e < len(part) and tags[e] == tags[s] + 1:
                e += 1
            if ANCHOR.search(part, s, e):
                out.append((s, e, int(tags[s] - 1) // 2))
        return out

    def decode(self, group: list[str]) -> np.ndarray:
        """Best tags of each text of group, a row each."""
        where, rows = [], []
        for n, part in enumerate(group):
            c = codes(part)
            for s in windows(len(c)):
                row = np.zeros(WIDTH, np.int64)
                row[: len(c) - s] = c[s : s + WIDTH]
                rows.append(row)
                where.append((n, s))
        length = max(len(p) for p in group)
        sums = np.zeros((len(group), length + WIDTH, TAGS), np.float32)
        seen = np.zeros((len(group), length + WIDTH, 1), np.float32)
        for a in range(0, len(rows), 1024):
            for (n, s), e in zip(where[a : a + 1024], self.emissions(np.array(rows[a : a + 1024]))):
                sums[n, s : s + WIDTH] += e
                seen[n, s : s + WIDTH] += 1
        em = (sums / np.maximum(seen, 1))[:, :length]
        for n, p in enumerate(group):
            em[n, len(p) :, 1:] = -1e4
            em[n, len(p) :, 0] = 0
        return self.viterbi(em)


def labelled_windows(texts: list[str], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of the windows around digits and @, tags from base spans."""
    xs, ys = [], []
    for text in texts:
        spans = base_spans(text)
        for a, b in stretches(text):
            c, tags = codes(text[a:b]), np.zeros(b - a, np.int64)
            for s, e, k in spans:
                if a <= s and e <= b and not tags[s - a : e - a].any():
                    tags[s - a] = 1 + 2 * k
                    tags[s - a + 1 : e - a] = 2 + 2 * k
            for s in windows(b - a, stride):
                x, y = np.zeros(WIDTH, np.int64), np.zeros(WIDTH, np.int64)
                x[: b - a - s], y[: b - a - s] = c[s : s + WIDTH], tags[s : s + WIDTH]
                if len(y) and y[0] and y[0] % 2 == 0:
                    continue  # begins inside a span
                xs.append(x)
                ys.append(y)
    return np.array(xs, dtype=np.int64).reshape(-1, WIDTH), np.array(ys, dtype=np.int64).reshape(-1, WIDTH)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_fit: int = MAX_FIT) -> Tagger:
    """A tagger from at most max_fit documents with a digit or @ (smallest hash of the id).

    Only the stretches around digits and @ leave the executors.
    """
    chosen = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.xxhash64(id_col, text_col).alias("h")).orderBy("h").limit(max_fit)
    last = chosen.agg(F.max("h")).first()[0]
    if last is None:
        return Tagger()

    def cut(batches):
        for batch in batches:
            # A long stretch is learned from in pieces.
            parts = [t[x : min(b, x + SEGMENT)] for t in batch.column(0).to_pylist() for a, b in stretches(t) for x in range(a, b, SEGMENT)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], names=["part"])

    rows = docs.where(F.col(text_col).rlike("[0-9@]") & (F.xxhash64(id_col, text_col) <= last)).select(text_col)
    parts = [r[0] for r in map_arrow(rows, cut, "part string").distinct().orderBy(F.xxhash64("part"), "part").limit(MAX_WINDOWS).collect()]
    # Of few texts the windows stand closer, so that the model sees spans at many places.
    for stride in (8, 16, STRIDE):
        x, y = labelled_windows(parts, stride)
        if len(x) <= MAX_WINDOWS:
            break
    model = Tagger()
    if y.any():
        model.fit(x[:MAX_WINDOWS], y[:MAX_WINDOWS])
    return model


def find(docs: DataFrame, model: Tagger, *, text_col: str = "text") -> DataFrame:
    """docs with base and spans: arrays of (kind, start, end), in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ["base", "spans"]
    keep = [c for c in docs.columns if c not in new]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = fields(docs, keep, ", ".join(f"{c} array<struct<kind:string,start:int,end:int>>" for c in new))

    def run(batches):
        m = shared.value
        for batch in batches:
            step = max(1, 4_000_000 // max(1, batch.nbytes // max(1, batch.num_rows)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                base, places, pieces = [], [], []
                for n, text in enumerate(part.column(part.schema.get_field_index(text_col)).to_pylist()):
                    text = text or ""
                    base.append(base_spans(text))
                    for a, b in stretches(text):
                        places.append((n, a))
                        pieces.append(text[a:b])
                every = [list(b) for b in base]
                for (n, a), found in zip(places, m.find(pieces)):
                    every[n] += apart([(s + a, e + a, k) for s, e, k in found], base[n])
                cols = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in sorted(x, key=lambda v: (v[0], v[2], v[1]))] for x in rows], kind) for rows in (base, every)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + cols, names=keep + new)

    return map_arrow(docs.select(*keep), run, schema)


def redact(docs: DataFrame, model: Tagger, *, text_col: str = "text") -> DataFrame:
    """docs with each span of text replaced by its kind in brackets."""
    found = find(docs, model, text_col=text_col)
    # From the last span to the first, so that earlier offsets hold; a span inside another goes with it.
    start = F.struct(F.col(text_col).alias("text"), F.lit(2**31 - 1).alias("limit"))

    def step(acc, s):
        cut = F.concat(F.substring(acc["text"], F.lit(1), s["start"]), F.lit("["), s["kind"], F.lit("]"), F.substring(acc["text"], s["end"] + 1, F.lit(2**31 - 1)))
        return F.when(s["end"] <= acc["limit"], F.struct(cut.alias("text"), s["start"].alias("limit"))).otherwise(acc)

    return found.withColumn(text_col, F.aggregate(F.reverse("spans"), start, step)["text"])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, fit(docs)).drop("text")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(k):
        return F.size(F.filter("base", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{k}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(F.encode(joined("base"), "UTF-8"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def sha256(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
