"""Markdown for people, put together from aggregates: reviews, link, latency and impact reports, triage comments.

A list shows its first entries by an order and says how many more there are, so
only those few leave the executors whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .review import code_span
from .triage import cut_to_bytes

MAX_LINES, MAX_PLACES, MAX_SHOWN = 30, 5, 2000
#: Bytes of a comment that a code host takes.
MAX_COMMENT = 60 * 1024


def capped_list(rows: DataFrame, line: Column, order: list, cap: int = MAX_LINES) -> DataFrame:
    """One row (n, list): the first cap lines by order, one to a row, and how many more."""
    numbered = rows.select(line.alias("line"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    keys = [f"o{i}" for i in range(len(order))]
    first = numbered.orderBy(*keys, "line").limit(cap).agg(F.array_sort(F.collect_list(F.struct(*keys, "line"))).alias("first"))
    # Both sides are one row.
    both = rows.agg(F.count(F.lit(1)).alias("n")).join(first, F.lit(True))
    shown = F.array_join(F.transform("first", lambda x: F.concat(F.lit("- "), x["line"])), "\n")
    more = F.when(F.col("n") > cap, F.concat(F.lit("\n- and "), (F.col("n") - cap).cast("string"), F.lit(" more"))).otherwise("")
    return both.select("n", F.concat(shown, more).alias("list"))


def section(title: str, rows: DataFrame, line: Column, order: list, cap: int = MAX_LINES) -> DataFrame:
    """One row (n, body): a heading with the count and the list; empty where there is nothing to list."""
    out = capped_list(rows, line, order, cap)
    head = F.concat(F.lit(f"## {title} ("), F.col("n").cast("string"), F.lit(")\n\n"))
    return out.select("n", F.when(F.col("n") > 0, F.concat(head, F.col("list"), F.lit("\n"))).otherwise("").alias("body"))


def page(title: str, sections: list[DataFrame], empty: str) -> DataFrame:
    """One row (body): the sections that have something, under a title, cut to MAX_COMMENT bytes at a line's end."""
    out, names = None, []
    for i, s in enumerate(sections):
        names.append(f"b{i}")
        one = s.select(F.col("body").alias(f"b{i}"))
        out = one if out is None else out.join(one, F.lit(True))
    parts = F.filter(F.array(*names), lambda x: x != "")
    body = F.when(F.size(parts) == 0, F.lit(empty + "\n")).otherwise(F.array_join(parts, "\n"))
    return out.select(cut_to_bytes(F.concat(F.lit(f"# {title}\n\n"), body), MAX_COMMENT).alias("body"))


def places(locations: Column, cap: int = MAX_PLACES) -> Column:
    """file:line of the first cap of an array of (file, line), and how many more."""
    text = F.array_join(F.transform(F.slice(locations, 1, cap), lambda x: F.concat_ws(":", x["file"], x["line"].cast("string"))), ", ")
    return F.concat(text, F.when(F.size(locations) > cap, F.concat(F.lit(" and "), (F.size(locations) - cap).cast("string"), F.lit(" more"))).otherwise(""))


def link_report(links: DataFrame, outage: bool = False) -> DataFrame:
    """links: url, status (dead, unverified, ok), locations. Where no link could be reached the network is to blame, and none is listed."""
    line = F.concat(F.lit("<"), F.col("url"), F.lit("> "), places(F.col("locations")))
    kinds = [] if outage else ["dead", "unverified"]
    parts = [section(k, links.where(F.col("status") == k), line, [F.col("url")]) for k in kinds] or [section("none", links.where("false"), line, [F.col("url")])]
    return page("Links", parts, "No link could be reached; nothing is judged." if outage else "All links are alive.")


def latency_report(deltas: DataFrame) -> DataFrame:
    """deltas: payload, base, head, regression."""
    ms = lambda c: F.concat(F.round(c, 1).cast("string"), F.lit(" ms"))
    line = F.concat(F.col("payload"), F.lit(": "), ms(F.col("base")), F.lit(" to "), ms(F.col("head")))
    slower = section("Slower", deltas.where("regression"), line, [F.col("payload")])
    return page("Latency", [slower, section("Others", deltas.where("not regression"), line, [F.col("payload")])], "Nothing was measured.")


def impact_report(diff: DataFrame, counts: DataFrame, moves: DataFrame) -> DataFrame:
    """diff: source, bad, change, columns. counts: source, bad, before, after. moves: key, move."""
    rule = lambda: F.concat(code_span(F.col("bad")), F.lit(" ("), F.col("source"), F.lit(")"))
    changed = F.concat(rule(), F.lit(": "), F.col("change"), F.when(F.col("columns") != "", F.concat(F.lit(" "), F.col("columns"))).otherwise(""))
    hits = F.concat(rule(), F.lit(": "), F.col("before").cast("string"), F.lit(" to "), F.col("after").cast("string"))
    parts = [
        section("Rules", diff, changed, [F.col("source"), F.col("bad")]),
        section("Findings", counts, hits, [-F.abs(F.col("after") - F.col("before")), F.col("source"), F.col("bad")]),
        section("In and out of the document", moves, F.concat(F.col("key").cast("string"), F.lit(" "), F.col("move")), [F.col("key")]),
    ]
    return page("Impact of the rules", parts, "No rule changed.")


def review_body(findings: DataFrame) -> DataFrame:
    """findings: bad, good, filename, line. One row (body): each kind once with how often it is found, by first place."""
    kinds = findings.groupBy("bad", "good").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("filename", "line")).alias("first"))
    line = F.concat(code_span(F.col("bad")), F.lit(" → "), code_span(F.col("good")), F.when(F.col("times") > 1, F.concat(F.lit(" ("), F.col("times").cast("string"), F.lit(" times)"))).otherwise(""))
    return page("Expressions", [section("Kinds", kinds, line, [F.col("first"), F.col("bad")], 20)], "Nothing found.")


def sticky_body(body: Column, marker: str, out_of_diff: Column) -> Column:
    """The comment that is kept up to date: a marker to find it again, the body, and what stands outside the diff."""
    rest = F.when(out_of_diff > 0, F.concat(F.lit("\nOutside the diff: "), out_of_diff.cast("string"), F.lit("\n"))).otherwise("")
    return F.concat(F.lit(marker + "\n"), body, rest)


def reviews_to_minimize(reviews: DataFrame, login: str, marker: str, keep: int | None = None) -> DataFrame:
    """ids of our own earlier reviews (id, author, body) that carry the marker, but for the one to keep."""
    mine = reviews.where((F.col("author") == login) & F.contains(F.col("body"), F.lit(marker)))
    return mine.where(F.col("id") != keep if keep is not None else F.lit(True)).select("id")


def shown(text: Column, limit: int = MAX_SHOWN) -> Column:
    """text as a reader sees it in a comment: its beginning where it is long, and that there is more."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def triage_comment(labels: Column, said: Column, found: Column) -> Column:
    """A comment on a report: its labels, the text that was given, and what was found in it (an array of strings)."""
    block = F.concat(F.lit("> "), F.replace(shown(said), F.lit("\n"), F.lit("\n> ")))
    lines = F.when(F.size(found) > 0, F.array_join(F.transform(F.slice(found, 1, MAX_LINES), lambda x: F.concat(F.lit("- "), code_span(x))), "\n")).otherwise("Nothing found.")
    return F.concat(F.lit("Labels: "), F.array_join(labels, ", "), F.lit("\n\n"), block, F.lit("\n\n"), lines)


def leak_advice(kind: Column, n: Column, where: Column) -> Column:
    """What a person is told about personal data in a call: where, how many, what to do. No digit of them is in it."""
    place = F.when(kind == "path", "the file's name").when(kind == "command", "the command").otherwise(F.concat(F.lit("the text of "), F.coalesce(where, F.lit("a file"))))
    return F.concat(n.cast("string"), F.when(n == 1, " resident number").otherwise(" resident numbers"), F.lit(" in "), place, F.lit("; use made-up ones, or mark the line as allowed."))


def repository_language(commits: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Rows (key, language): what the commits (language) say; where they are unknown, the documents."""
    rows = commits.select(key, F.col("language").alias("c")).join(documents.select(key, F.col("language").alias("d")), key, "full")
    return rows.select(key, F.when(F.coalesce("c", F.lit("unknown")) != "unknown", F.col("c")).otherwise(F.coalesce("d", F.lit("unknown"))).alias("language"))


def reproduced(template: Column, n_findings: Column, wanted: Column, found: Column) -> Column:
    """Whether a report shows again: the reported expression (wanted) is among those found (an array), or is missing as reported."""
    among = F.when(F.coalesce(wanted, F.lit("")) == "", n_findings > 0).otherwise(F.array_contains(found, wanted))
    return F.when(template == "missed-expression", ~among).otherwise(among)
