"""Reconciliation: links and their probes, findings against earlier reviews, diffs, latency, graders, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import let, matches, running_sums
from .rules import PRIORITIES

# Characters that end a URL, that it doesn't end with, and pairs of brackets.
URL = "https?://[^\\s\"'<>\\[\\]{}`*|·\\x{2010}-\\x{206F}ᄀ-ᇿ㄰-㆏가-힣\\x{3000}-\\x{303F}]+"
TRAILING = ".,;:!?~、。”’\"'》〉」』("
CLOSERS = {")": "(", "]": "[", "}": "{", ">": "<"}


def trim_url(url: Column) -> Column:
    """url without punctuation and unbalanced closers at its end, until there is none.

    All that may go is one run of such characters at the end; of it stays what
    leads up to the last closer that has an opener.
    """
    run = F.regexp_extract(url, f"[{_in_class(TRAILING + ''.join(CLOSERS))}]+$", 0)
    head = F.substring(url, F.lit(1), F.length(url) - F.length(run))
    count = lambda c: F.length(head) - F.length(F.replace(head, F.lit(c)))

    def balanced(chars, close, open_):
        # Closers without an opener so far; a closer stays where there is none too many.
        net = running_sums(F.transform(chars, lambda c: (c == close).cast("int") - (c == open_).cast("int")))
        stays = F.zip_with(chars, net, lambda c, n: (c == close) & (n + count(close) - count(open_) <= 0))
        return F.array_max(F.transform(stays, lambda ok, i: F.when(ok, i + 1).otherwise(0)))

    kept = let(F.split(run, ""), lambda chars: F.greatest(*[balanced(chars, c, o) for c, o in CLOSERS.items()]))
    return F.when(run == "", url).otherwise(F.concat(head, F.substring(run, F.lit(1), kept)))


def _in_class(chars: str) -> str:
    return "".join("\\" + c if c in "\\]^-[" else c for c in chars)


def excluded_url(url: Column, own_prefix: str, hosts: list[str]) -> Column:
    return F.lower(url).contains(own_prefix.lower()) | F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))).isin(hosts)


def extract_links(docs: DataFrame, doc: str, text_col: str) -> DataFrame:
    """Rows (doc, line, url), line from 1."""
    lines = docs.select(doc, F.posexplode(F.split(text_col, "\n", -1)).alias("n", "line"))
    return lines.select(doc, (F.col("n") + 1).cast("long").alias("line"), F.explode(F.regexp_extract_all("line", F.lit(URL), 0)).alias("url")).withColumn("url", trim_url(F.col("url")))


def group_links(links: DataFrame, doc: str) -> DataFrame:
    return links.groupBy("url").agg(F.sort_array(F.collect_list(F.struct(F.col(doc).alias("file"), "line"))).alias("locations"), F.count(F.lit(1)).alias("n"))


def link_status(http: Column, exit_code: Column, title: Column) -> Column:
    """In order: no host, gone, timed out, other failure, no answer, error, dead or doubtful title."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(exit_code.isin(6, 7), "dead")
        .when(http.isin(404, 410), "dead")
        .when(exit_code == 28, "unverified")
        .when(exit_code != 0, "unverified")
        .when(http.isNull(), "unverified")
        .when(http >= 400, "unverified")
        .when(t.rlike(r"오류\s*페이지|페이지를\s*찾을\s*수\s*없습니다|존재하지\s*않는\s*(?:페이지|법령)"), "soft_dead")
        .when(t.rlike(r"not\s*found|(?<![a-z0-9_])error(?![a-z0-9_])"), "unverified")
        .otherwise("ok")
    )


def split_links(links: DataFrame, probes: DataFrame) -> DataFrame:
    """links with status; a link without a probe is unverified."""
    rows = links.join(probes, "url", "left")
    return rows.withColumn("status", F.when(F.col("curl_exit").isNull(), "unverified").otherwise(link_status(F.col("http_code"), F.col("curl_exit"), F.col("title"))))


def runner_outage(probes: DataFrame) -> DataFrame:
    """One row: whether there are links and none could be reached."""
    return probes.agg((F.count(F.lit(1)) > 0).alias("any"), F.coalesce(F.bool_and(F.col("curl_exit").isin(6, 7)), F.lit(False)).alias("all")).select((F.col("any") & F.col("all")).alias("outage"))


def fingerprint(file: Column, key: Column, bad: Column, line: Column) -> Column:
    """sha1 of the four parts; a null part is empty and keeps its place."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.sha1(F.encode(F.concat_ws("|", part(file), part(key), part(bad), F.trim(part(line))), "UTF-8"))


def plan_review(findings: DataFrame, threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings to post, thread_ids to resolve): two anti-joins on fingerprints.

    findings: fp. threads, a row for each fingerprint: thread_id, fp, is_resolved,
    is_outdated, ours, human_reply. What an open thread of ours has is not posted
    again; a thread of ours is resolved when none of its fingerprints is current
    and no person has answered.
    """
    ours = threads.where("ours AND NOT is_resolved")
    post = findings.join(ours.where("NOT is_outdated").select("fp").distinct(), "fp", "left_anti")
    current = ours.join(findings.select("fp").distinct(), "fp", "left_semi").select("thread_id").distinct()
    return post, ours.where("NOT human_reply").select("thread_id").distinct().join(current, "thread_id", "left_anti")


def commentable_lines(patches: DataFrame, file: str = "filename", patch: str = "patch") -> DataFrame:
    """Rows (file, line, text): new-file lines that a unified diff shows."""
    rows = patches.select(file, F.posexplode(F.split(patch, "\n", -1)).alias("n", "row"))
    w = Window.partitionBy(file).orderBy("n")
    head = F.regexp_extract("row", r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)", 1)
    rows = rows.withColumn("hunk", F.last(F.when(head != "", F.col("n")), True).over(w)).withColumn("first", F.last(F.when(head != "", head.try_cast("int")), True).over(w))
    shows = (head == "") & F.col("hunk").isNotNull() & F.col("row").rlike(r"^[ +]")
    rows = rows.withColumn("shown", shows)
    at = F.sum(F.col("shown").cast("int")).over(Window.partitionBy(file, "hunk").orderBy("n"))
    return rows.withColumn("line", (F.col("first") + at - 1).cast("long")).where("shown").select(file, "line", F.expr("substring(row, 2)").alias("text"))


def comments(findings: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grouped comments, findings out of the diff) of findings (filename, line, message)."""
    keys = ["filename", "line"]
    inside = findings.join(lines.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("message")), "\n").alias("body"), F.count(F.lit(1)).alias("n"))
    return inside, findings.join(lines.select(*keys).distinct(), keys, "left_anti")


def issue_fields(issues: DataFrame, key: str, body: str) -> DataFrame:
    """Rows (key, label, value) of "### label" sections; fences go, "_No response_" is empty."""
    text = F.replace(F.col(body), F.lit("\r\n"), F.lit("\n"))
    labels = F.regexp_extract_all(text, F.lit(r"(?dm)^### ([^\n]*\S)[ \t]*$"), 1)
    parts = F.split(text, r"(?dm)^### [^\n]*\S[ \t]*$", -1)
    parts = F.slice(parts, 2, F.size(parts))
    rows = issues.select(key, F.explode(F.arrays_zip(labels.alias("label"), parts.alias("value"))).alias("f")).select(key, F.trim("f.label").alias("label"), F.regexp_replace("f.value", r"^\s+|\s+$", "").alias("value"))
    fenced = F.regexp_replace("value", r"(?s)^(`{3,})[^\n]*\n(.*?)\n\1\s*$", "$2")
    return rows.withColumn("value", F.when(F.col("value") == "_No response_", "").otherwise(F.trim(fenced)))


def graded(answers: DataFrame) -> DataFrame:
    """Weighted score by case and arm of (case, arm, type, weight, pattern, answer)."""
    hit = F.regexp_like("answer", F.col("pattern"))
    ok = F.when(F.col("type") == "contains", hit).otherwise(~hit).cast("int")
    return answers.groupBy("case", "arm").agg(F.round(F.sum(F.col("weight") * ok) / F.sum("weight"), 6).alias("score"))


def budgeted(rows: list[tuple[str, str, str, int, str]], total: int, prompt_share: float = 0.5) -> list[str]:
    """Keys admitted under a character budget, in the order of admission.

    rows: (key, lane, heading, cost, priority), in order within a priority. Of what
    is there for rows the prompt lane has prompt_share and the terms the rest; rows
    alone count against a lane, rows and headings (at their first row) against
    total. A priority is done before the next begins: what it put off for its lane
    is tried at its end with whatever is left. A running sum cannot express this,
    since rows left out cost nothing. Hundreds of rows, on the driver.
    """
    budget = {"prompt": int(total * prompt_share)}
    budget["terms"] = total - budget["prompt"]
    spent, used, headings, taken = {"prompt": 0, "terms": 0}, 0, set(), []
    for key, lane, heading, cost in attempts(rows):
        price = cost + (0 if heading in headings else len(heading) + 1)
        if key in taken or used + price > total or (lane and spent[lane] + cost > budget[lane]):
            continue
        used += price
        if lane:
            spent[lane] += cost
        headings.add(heading)
        taken.append(key)
    return taken


def attempts(rows: list[tuple[str, str, str, int, str]]) -> list[tuple[str, str | None, str, int]]:
    """(key, lane, heading, cost) in the order in which rows are tried: each priority twice, the second time in no lane."""
    tiers = [[r for r in rows if r[4] == p] for p in PRIORITIES]
    return [(r[0], lane and r[1], r[2], r[3]) for tier in tiers for lane in (True, None) for r in tier]


def escape_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula, quoted where CSV asks for it."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def csv_lines(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(F.concat_ws(",", *[escape_cell(F.col(c)) for c in cols]).alias("value"))


def code_span(text: Column) -> Column:
    """Markdown code with a fence longer than any in it."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), 0), lambda t: F.length(t))), F.lit(0))
    fence = F.repeat(F.lit("`"), longest + 1)
    return F.concat(fence, text, fence)


def positions_of(docs: DataFrame, doc: str, text_col: str, pattern: str) -> DataFrame:
    return docs.select(doc, F.explode(matches(F.col(text_col), pattern)).alias("m")).select(doc, "m.*")
