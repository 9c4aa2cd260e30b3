"""The rule scan: documents against rules, boundaries, overlaps, caps and fixes.

Rules are a dimension of bounded size (MAX_ALTERNATIVES, checked), broadcast to
every task; documents are never shuffled. A match takes with it the characters
around it that decide on its boundaries, so that no text goes further than the
task that reads it: windows and joins see findings alone, all dealt by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hangul import composed, final_sound, is_composed
from ..functions.particles import HEADS
from .positions import let, matches_of, part_of, rebuild, text_pieces
from .rules import ALT_SCHEMA, rule_alternatives

MAX_ALTERNATIVES = 20_000
MAX_PER_RULE = 3
MAX_RAW, MAX_TRIED = 50, 1000

# What may follow a term without making it part of another word.
FOLLOWERS = [
    "이에요", "예요", "입니다", "입니까", "이나마", "이었", "이랑", "까지", "부터", "처럼", "이나", "이며", "이라", "이면", "이", "가", "을", "를", "은", "는",
    "의", "에서", "에게", "께", "에", "으로", "로", "와", "과", "랑", "도", "만", "보다", "나", "요", "였", "여", "며", "라", "란", "냐", "인", "면", "들", "뿐",
    "마다", "밖에", "조차", "마저", "쯤", "대로", "끼리", "씩", "엔", "치고", "고", "야", "므로", "거나", "일", "임", "없이", "님", "데",
    "하", "해", "했", "한", "할", "함", "합", "되", "된", "될", "됨", "돼", "됐", "됩", "시키", "시켜", "시켰", "시킨", "시킬", "받", "상", "화", "형", "별", "중",
    "성", "감", "력", "률", "율", "습", "았", "었", "겠", "으", "게", "죠", "네", "든", "려",
]
RO_CONTINUATIONS = ["는", "도", "만", "서", "써", "부터", "의", "까지", "라도", "라면", "나", "요", "선", "은", "야", "밖에", "조차", "마저", "든", "인", "다가"]
HANGUL = "[가-힣ㄱ-ㅎㅏ-ㅣ]"
RO_RIGHT = "^(?:으로|로)(?:$|[^가-힣ㄱ-ㅎㅏ-ㅣ]|" + "|".join(RO_CONTINUATIONS) + ")"
FOLLOWER = "^(?:" + "|".join(sorted(FOLLOWERS, key=lambda t: (-len(t), t))) + ")"


def allowed_follower(rest: Column, allow_jeok: Column) -> Column:
    """rest: what stands after the match, twelve characters are enough."""
    return F.when((rest == "") | ~rest.rlike(f"^{HANGUL}"), True).when(rest.rlike("^(?:으로|로)"), rest.rlike(RO_RIGHT)).otherwise(rest.rlike(FOLLOWER) | (allow_jeok & rest.startswith("적")))


#: Characters after a match that its boundary can depend on.
AROUND = 12


def _placed(pieces: Column, hits: Column) -> Column:
    """(start, hit, before, rest) of matches: the character before each, and AROUND after it."""

    def around(h, p):
        # A match and what follows it, cut to what can be seen from the match before.
        steps = F.zip_with(h, F.slice(p, 2, F.size(h)), lambda x, after: F.substring(F.concat(x, F.substring(after, 1, AROUND)), 1, AROUND))

        def context(m, i, steps):
            own = F.get(p, i)
            before = F.when(own != "", F.right(own, F.lit(1))).when(i > 0, F.right(F.get(h, i - 1), F.lit(1))).otherwise("")
            rest = F.concat(F.substring(F.get(p, i + 1), 1, AROUND), F.array_join(F.slice(steps, i + 2, AROUND), ""))
            return F.struct(m["start"].alias("start"), m["hit"].alias("hit"), before.alias("before"), F.substring(rest, 1, AROUND).alias("rest"))

        return let(steps, lambda s: F.transform(matches_of(p, h), lambda m, i: context(m, i, s)))

    return let(F.struct(pieces.alias("p"), hits.alias("h")), lambda x: around(x["h"], x["p"]))


def raw_hits(docs: DataFrame, rules, text_col: str = "masked") -> DataFrame:
    """Rows (doc columns but the text, rule columns, start, len, matched, before, rest) of every match of every alternative.

    docs × rules is a broadcast nested-loop join on "the text contains the
    rule's longest literal"; patterns run only on pairs that pass it. Columns of
    docs that are named as a rule's give way to it.
    """
    rows = rule_alternatives(rules)
    if len(rows) > MAX_ALTERNATIVES:
        raise ValueError(f"{len(rows)} alternatives; a scan takes {MAX_ALTERNATIVES}, split the table")
    names = [c.split()[0] for c in ALT_SCHEMA.split(", ")]
    alts = docs.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in rows], ALT_SCHEMA)
    keep = [c for c in docs.columns if c != text_col and c not in names]
    pairs = docs.select(*keep, text_col).join(F.broadcast(alts), F.col(text_col).contains(F.col("literal")))
    # Literal alternatives are quoted patterns; only those with a wildcard hold more.
    pieces, found = F.split(F.col(text_col), F.col("pattern"), -1), F.regexp_extract_all(F.col(text_col), F.col("pattern"), F.lit(0))
    hits = pairs.select(*keep, *names, F.explode(_placed(pieces, found)).alias("__m"))
    return hits.select(*keep, *names, F.col("__m.start").alias("start"), F.length("__m.hit").alias("len"), F.col("__m.hit").alias("matched"), F.col("__m.before").alias("before"), F.col("__m.rest").alias("rest"))


def within_boundaries(hits: DataFrame) -> DataFrame:
    """hits whose neighbours don't make them part of another word; before and rest go."""
    before = F.col("before")
    ok = ~(F.col("left") & before.rlike(HANGUL)) & ~(F.col("left_digit") & before.rlike("[0-9.]")) & (~F.col("right") | allowed_follower(F.col("rest"), F.col("allow_jeok")))
    return hits.where(ok).drop("before", "rest")


def first_per_rule(hits: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The first n by place for each of by: a window with a group limit."""
    w = Window.partitionBy(*by).orderBy("start", "rule_ord", "alt_ord")
    return hits.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def leftmost_alternative(hits: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Of one rule's alternatives at one place the first counts."""
    w = Window.partitionBy(doc, "rule_ord", "start").orderBy("alt_ord")
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


FINDING = ["rule_ord", "alt_ord", "bad", "good", "check", "priority", "source", "alt", "wild", "replacement", "start", "len", "matched"]


def resolve_overlaps(hits: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Longest first, then place, then rule: what meets an accepted one goes.

    Findings of rules with a wildcard inside neither give way nor push others
    out. Only what hangs together by overlaps is ordered and folded as one: an
    island, which ends where all before have ended.
    """
    order = ["neg", "start", "rule_ord", "alt_ord"]
    rest = [c for c in hits.columns if c not in (doc, *order)]
    ordered = Window.partitionBy(doc).orderBy("start", "rule_ord", "alt_ord")
    plain = hits.where("not wild").withColumn("__end", F.max(F.col("start") + F.col("len")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    plain = plain.withColumn("__island", F.count_if(F.col("__end").isNull() | (F.col("start") >= F.col("__end"))).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = plain.withColumn("neg", -F.col("len"))
    per = rows.groupBy(doc, "__island").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("all"))
    kind = per.schema["all"].dataType

    def step(acc, x):
        meets = F.exists(acc, lambda a: (a["start"] < x["start"] + x["len"]) & (x["start"] < a["start"] + a["len"]))
        return F.when(meets, acc).otherwise(F.array_append(acc, x))

    taken = F.when(F.size("all") == 1, F.col("all")).otherwise(F.aggregate("all", F.array().cast(kind), step))
    return per.select(doc, F.inline(taken)).select(*hits.columns).unionByName(hits.where("wild"))


def lint(docs: DataFrame, rules, *, doc: str = "doc_id", text_col: str = "masked", exhaustive: bool = False) -> DataFrame:
    """Findings (doc, FINDING) of all scanned rules: matches in bounds, overlaps resolved, at most MAX_PER_RULE of a rule unless exhaustive.

    Rules are written in composed Hangul; a text may be decomposed, so the match
    runs on its composed form and places are those of that form (functions.hangul.nfc).
    """
    # Used once and never null, so that a mask in text_col is worked out once.
    texts = docs.select(doc, F.coalesce(let(F.col(text_col), composed), F.lit("")).alias(text_col))
    hits = raw_hits(texts, rules, text_col)
    hits = hits.drop("literal", "pattern").repartition(doc)
    if not exhaustive:
        hits = first_per_rule(hits, MAX_TRIED, [doc, "rule_ord"])
    hits = leftmost_alternative(within_boundaries(hits).select(doc, *FINDING), doc)
    if not exhaustive:
        hits = first_per_rule(hits, MAX_RAW, [doc, "rule_ord"])
    hits = resolve_overlaps(hits, doc)
    return hits if exhaustive else first_per_rule(hits, MAX_PER_RULE, [doc, "bad"])


def particle_risk(bad: Column, good: Column, after: Column, before: Column) -> Column:
    """Why a replacement could break a particle near it; null where it can't."""
    last = lambda c: final_sound(F.right(F.rtrim(c), F.lit(1)))
    heads = list(HEADS)
    of_good, of_bad = last(good), last(bad)
    ro = after.isin("로", "으")
    return (
        F.when(F.substring(good, 1, 1).isin(heads) & last(before).isNotNull(), "starts_with_particle")
        .when(~after.isin(heads) | (after == ""), None)
        .when(ro & of_good.isNull(), "unknown_final")
        .when(ro & ((after == "으") != (of_good == "other")), "breaks_ro")
        .when(ro, None)
        .when(of_bad.isNull() | of_good.isNull(), "unknown_final")
        .when((of_bad == "") != (of_good == ""), "breaks_particle")
    )


def apply_fixes(docs: DataFrame, rules, *, doc: str = "doc_id", text_col: str = "masked", original: str | None = None) -> DataFrame:
    """docs with fixed (text), n_fixed and changes (start, len, new).

    Terms are found in text_col; what stands next to them and the fixed text are
    of original, a column of equal length (text_col itself, unless named). A text
    whose Hangul is decomposed is left as it is: places in it are not those of
    its composed form. Decided from right to left, since the character after a
    fix can be the first of the next one; put together from left to right.
    """
    text = F.col(original or text_col)
    fixable = docs.where(is_composed(text))
    found = lint(fixable, rules, doc=doc, text_col=text_col, exhaustive=True).where(F.col("check") == "치환")
    item = F.struct("start", "len", F.col("matched").alias("bad"), F.col("replacement").alias("new"))
    per = found.groupBy(doc).agg(F.array_sort(F.collect_list(item)).alias("todo"))
    rows = docs.join(per, doc, "left")
    out_type = "array<struct<start:int,len:int,new:string>>"

    def decided(todo, pieces):
        char = lambda at: part_of(pieces, at, F.lit(1))
        near = F.transform(todo, lambda x: F.struct(x.alias("x"), F.when(x["start"] > 0, char(x["start"] - 1)).otherwise("").alias("before"), char(x["start"] + x["len"]).alias("after")))
        # Runs of fixes that touch: within one, each depends on the next.
        zero = F.struct(F.lit(-1).alias("at"), F.lit("").alias("head"), F.lit(False).alias("good"), F.lit(None).cast("struct<start:int,len:int,new:string>").alias("out"))

        def step(acc, z):
            x = z["x"]
            after = F.when(acc["at"] == x["start"] + x["len"], acc["head"]).otherwise(z["after"])
            good = x["new"].isNotNull() & particle_risk(x["bad"], x["new"], after, z["before"]).isNull()
            change = F.struct(x["start"].alias("start"), x["len"].alias("len"), x["new"].alias("new"))
            return F.struct(F.when(good, x["start"]).otherwise(-1).alias("at"), F.when(good, F.substring(x["new"], 1, 1)).otherwise("").alias("head"), good.alias("good"), change.alias("out"))

        def run(group):
            return F.aggregate(F.reverse(group), F.array(zero), lambda acc, z: F.concat(F.array(step(acc[0], z)), acc))

        def groups(n):
            starts = F.filter(F.transform(n, lambda z, i: F.when((i == 0) | (z["x"]["start"] != F.get(n, i - 1)["x"]["start"] + F.get(n, i - 1)["x"]["len"]), i)), lambda i: i.isNotNull())
            return let(starts, lambda at: F.transform(at, lambda i, k: F.slice(n, i + 1, F.coalesce(F.get(at, k + 1), F.size(n)) - i)))

        done = F.flatten(F.transform(let(near, groups), run))
        return F.transform(F.filter(done, lambda d: d["good"]), lambda d: d["out"])

    changes = F.when(F.size("todo") > 0, let(text_pieces(text), lambda p: decided(F.col("todo"), p))).otherwise(F.array().cast(out_type))
    rows = rows.withColumn("__changes", F.coalesce(changes, F.array().cast(out_type)))
    return rows.withColumns({"fixed": rebuild(text, F.col("__changes")), "n_fixed": F.size("__changes").cast("long"), "changes": F.col("__changes")}).drop("__changes", "todo")
