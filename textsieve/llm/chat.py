"""Chat formatting by multi-party perspective rotation.

For each participant of a conversation the dialogue is rendered with that
speaker as assistant and every other speaker as a named user; system turns stay
system turns. mask holds the spans (code points, end exclusive) that count for
the loss: the assistant's words and their end mark.

Turn marks in a text are written with spaces inside, so that no text begins or
ends a turn. A name stands on one line, its line breaks and backslashes escaped.

A conversation is rendered in parts of PART_TURNS turn numbers, so that one
with very many turns is many rows and no task holds it whole; start says where
a part's text begins in the conversation's whole text. A turn number (or null)
that more than PART_TURNS rows share is dealt by the hash of speaker and text
into pieces of about as many, repeated rows too, and each piece is a part with
its own number in piece; so a part has PART_TURNS^2 rows at most, but for chance.
start is summed from lengths, before any text is rendered or moved.

Defined cases: a null text is empty; a null or empty speaker is "unknown"; null
conv_ids are one conversation; null turns come first, in part 0; repeated rows
are repeated turns; equal turn numbers are ordered by speaker, then text (by
piece first where there are several). A conversation of system turns alone has
no participant and no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.positions import running_sums
from .stage import join_counted, join_on_key, staged

PART_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
USER = "user name="
PART = ["conv_id", "part", "piece"]


def unmarked(text):
    """text without a turn mark."""
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("<|", "<| ").replace("|>", " |>")))
    return text


def shown_name(name):
    """name on one line; different names are shown differently."""
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("<|", "<\\|")):
        name = F.replace(name, F.lit(raw), F.lit(shown))
    return name


def with_pieces(said: DataFrame, part_turns: int) -> DataFrame:
    """said with piece: 0, but where more than part_turns rows share a turn."""
    crowd = said.groupBy(F.xxhash64("conv_id", "turn").alias("__ts_k")).agg(F.count(F.lit(1)).alias("__ts_n")).where(F.col("__ts_n") > part_turns)
    crowd = staged(crowd, "crowded-turns")
    if crowd.isEmpty():
        return said.withColumn("piece", F.lit(0))
    rows = join_counted(said.withColumn("__ts_k", F.xxhash64("conv_id", "turn")), crowd, ["__ts_k"], "__ts_n", "left")
    plain = rows.where(F.col("__ts_n").isNull()).select(*said.columns, F.lit(0).alias("piece"))
    # Equal rows are counted and dealt by their number.
    many = rows.where(F.col("__ts_n").isNotNull()).groupBy(*said.columns).agg(F.count(F.lit(1)).alias("__ts_m"), F.max("__ts_n").alias("__ts_n"))
    each = many.withColumn("__ts_j", F.explode(F.sequence(F.lit(1), F.col("__ts_m"))))
    pieces = F.ceil(F.col("__ts_n") / part_turns)
    dealt = each.select(*said.columns, F.pmod(F.xxhash64("who", "text") + F.floor(F.col("__ts_j") / 8), pieces).cast("int").alias("piece"))
    return plain.unionByName(dealt)


def rotate(turns: DataFrame, *, part_turns: int = PART_TURNS, system: str = "system") -> DataFrame:
    """Rows (conv_id, perspective, part, piece, n_turns, start, text, mask)."""
    said = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown")).alias("who"),
        unmarked(F.coalesce("text", F.lit(""))).alias("text"),
    )
    said = with_pieces(said, part_turns).withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)))
    return _rendered(said, _places(said, system), system)


def _places(said: DataFrame, system: str) -> DataFrame:
    """Rows (PART, perspective, start): where each part begins in the text of each perspective. No texts."""
    head = F.when(F.col("who") == system, len(system)).otherwise(F.length(shown_name(F.col("who"))) + len(USER))
    turn = len(OPEN) + head + 1 + F.length("text") + len(CLOSE) + 1
    # In a speaker's own perspective each of the own heads is another.
    own = len("assistant") - len(USER) - F.length(shown_name(F.col("who")))
    per = said.groupBy(*PART, "who").agg(F.sum(turn).alias("size"), F.sum(own).alias("own"))
    parts = per.groupBy(*PART).agg(F.sum("size").alias("size"))
    people = per.where(F.col("who") != system).select("conv_id", F.col("who").alias("perspective")).distinct()
    rows = join_on_key(people, parts, "inner", ["conv_id"])
    mine = per.select(*PART, F.col("who").alias("perspective"), "own")
    rows = join_on_key(rows, mine, "left", [*PART, "perspective"])
    before = Window.partitionBy("conv_id", "perspective").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("size") + F.coalesce("own", F.lit(0))
    return rows.select(*PART, "perspective", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long").alias("start"))


def _rendered(said: DataFrame, places: DataFrame, system: str) -> DataFrame:
    # array_sort puts the structs in order of turn (nulls first), speaker, text.
    parts = said.groupBy(*PART).agg(F.array_sort(F.collect_list(F.struct("turn", "who", "text"))).alias("turns"))
    rows = join_on_key(places, parts, "inner", PART)

    def head(t):
        return F.concat(F.lit(OPEN), F.when(t["who"] == F.col("perspective"), F.lit("assistant")).when(t["who"] == system, F.lit(system)).otherwise(F.concat(F.lit(USER), shown_name(t["who"]))), F.lit("\n"))

    rows = rows.withColumn("pieces", F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["who"] == F.col("perspective")).alias("own"))))
    # Where each turn ends, its line break with it.
    rows = rows.withColumn("ends", running_sums(F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + 1)))
    span = lambda p, e: F.when(p["own"], F.struct((e - 1 - F.length(p["body"])).alias("start"), (e - 1).alias("end")))
    return rows.select(
        "conv_id", "perspective", "part", "piece", F.size("turns").cast("long").alias("n_turns"), "start",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.array_compact(F.zip_with("pieces", "ends", span)).alias("mask"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return out.select("conv_id", "perspective", "part", "piece", "n_turns", "start", "text", spans.alias("mask"))


def _sql_replaced(text: str, pairs) -> str:
    for raw, shown in pairs:
        text = f"replace({text}, {raw}, {shown})"
    return text


_MARKS = [(f"'{m}'", "'" + m.replace("<|", "<| ").replace("|>", " |>") + "'") for m in (OPEN, CLOSE)]
_NAME = [("chr(92)", "chr(92) || chr(92)"), ("chr(10)", "chr(92) || 'n'"), ("chr(13)", "chr(92) || 'r'"), ("'<|'", "'<' || chr(92) || '|'")]
SQL = f"""
WITH s AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS who, {_sql_replaced("coalesce(text, '')", _MARKS)} AS text,
         coalesce(turn // {PART_TURNS}, 0) AS part FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS perspective FROM s WHERE who <> 'system'),
r AS (
  SELECT s.*, p.perspective, who = p.perspective AS own,
    '{OPEN}' || CASE WHEN who = p.perspective THEN 'assistant' WHEN who = 'system' THEN 'system'
      ELSE '{USER}' || {_sql_replaced("who", _NAME)} END || chr(10) AS head, text || '{CLOSE}' AS body
  FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part
    ORDER BY turn NULLS FIRST, who, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at0,
    row_number() OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, who, text) AS rn FROM r),
g AS (
  SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY rn) AS text,
    coalesce(string_agg(cast(at0 + length(head) AS varchar) || ':' || cast(at0 + length(head) + length(body) AS varchar), ',' ORDER BY rn)
      FILTER (WHERE own), '') AS mask
  FROM o GROUP BY conv_id, perspective, part)
SELECT conv_id, perspective, cast(part AS bigint) AS part, 0 AS piece, cast(n_turns AS bigint) AS n_turns,
  cast(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start,
  text, mask FROM g
"""
