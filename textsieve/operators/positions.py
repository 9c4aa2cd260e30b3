"""Matches with their places, interval algebra and piecewise rebuilding, as column expressions.

All of them take time in proportion to n log n of the matches of a text. Spark's
array functions copy an array each time something is added to it, so nothing here
grows one in a fold: places are running sums, which double their reach in every
pass, and parts of a text are cut from pieces of a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "array<struct<start:int,hit:string>>"
SPANS = "array<struct<s:int,e:int>>"
#: Characters in a piece of a text that parts are cut from.
PIECE = 256
#: Reaches of the passes of a running sum: enough for a thousand million elements.
REACHES = f"array({', '.join(str(1 << k) for k in range(30))})"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """values with each element joined by op, which is associative, to all before it."""
    passes = lambda v: F.filter(F.expr(REACHES), lambda k: k < F.size(v))
    double = lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= k, op(F.get(acc, i - k), x)).otherwise(x))
    return let(values, lambda v: F.aggregate(passes(v), v, double))


def running_sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return running(values, F.greatest)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, hit) of the non-overlapping matches of pattern, start from 0.

    The places follow from the lengths of the pieces between the matches.
    """
    return matches_of(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0))


def matches_of(pieces: Column, hits: Column) -> Column:
    def placed(h):
        # Where each match ends: the pieces and matches up to it.
        ends = running_sums(F.zip_with(h, F.slice(pieces, 1, F.size(h)), lambda x, p: F.length(p) + F.length(x)))
        found = F.zip_with(h, ends, lambda x, e: F.struct((e - F.length(x)).alias("start"), x.alias("hit")))
        return F.when(F.size(h) > 0, F.filter(found, lambda m: m["hit"] != "")).otherwise(F.array().cast(MATCHES))

    return let(hits, placed)


def spans(found: Column) -> Column:
    """(s, e) of matches, e exclusive."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("s"), (m["start"] + F.length(m["hit"])).alias("e")))


def merge_spans(ranges: Column) -> Column:
    """Union of (s, e) ranges, by s. Ranges that touch stay apart."""

    def united(r):
        def from_ends(e):
            # A range that begins where all before it have ended begins a new one.
            heads = F.filter(F.transform(r, lambda x, i: F.when((i == 0) | (x["s"] >= F.get(e, i - 1)), i)), lambda i: i.isNotNull())
            return let(heads, lambda h: F.transform(h, lambda i, k: F.struct(F.get(r, i)["s"].alias("s"), F.get(e, F.coalesce(F.get(h, k + 1), F.size(r)) - 1).alias("e"))))

        return F.when(F.size(r) < 2, r).otherwise(let(running_max(F.transform(r, lambda x: x["e"])), from_ends))

    return let(F.array_sort(ranges), united).cast(SPANS)


def text_pieces(text: Column) -> Column:
    """text in pieces of PIECE characters, for part_of: a place in a long string is found by counting from its beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0)


def part_of(pieces: Column, start: Column, length: Column) -> Column:
    """length characters from place start (from 0) of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((start + length) / PIECE).cast("int")
    near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.when(length > 0, F.substring(near, start - first * PIECE + 1, length)).otherwise("")


def overwrite(text: Column, ranges: Column, mark: str) -> Column:
    """text with the merged ranges overwritten, a mark for each character."""
    return rebuild(text, F.transform(ranges, lambda r: F.struct(r["s"].alias("start"), (r["e"] - r["s"]).alias("len"), F.repeat(F.lit(mark), r["e"] - r["s"]).alias("new"))))


def rebuild(text: Column, changes: Column) -> Column:
    """text with each (start, len, new) put in place; changes are in order and don't overlap."""

    def from_pieces(pieces, c):
        def piece(x, i):
            end = F.when(i > 0, F.get(c, i - 1)["start"] + F.get(c, i - 1)["len"]).otherwise(0)
            return F.concat(part_of(pieces, end, x["start"] - end), x["new"])

        done = F.element_at(c, -1)["start"] + F.element_at(c, -1)["len"]
        return F.concat(F.array_join(F.transform(c, piece), ""), part_of(pieces, done, F.length(text) - done))

    return let(changes, lambda c: F.when(F.size(c) == 0, text).otherwise(let(text_pieces(text), lambda p: from_pieces(p, c))))
