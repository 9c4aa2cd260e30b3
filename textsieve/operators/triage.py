"""Rule upkeep: where a rule stands, what check it can bear, reports against it, versions and published links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import let, matches, rebuild, running_sums
from .rules import _strip, alternative_pattern, alternatives, replacement

MAX_PATTERN, MAX_SUBSTITUTE = 40, 24


def rule_locations(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows (source, bad) with line: the first table line of its file with bad in a cell."""
    lines = files.select("source", F.posexplode(F.split("text", "\n", -1)).alias("n", "row")).where(F.ltrim("row").startswith("|"))
    cells = lines.select("source", (F.col("n") + 1).cast("long").alias("line"), F.explode(F.split("row", r"\|", -1)).alias("cell")).select("source", "line", F.trim("cell").alias("bad"))
    return rows.join(cells.groupBy("source", "bad").agg(F.min("line").alias("line")), ["source", "bad"], "left")


def owners(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """findings with the source of the first rule of the same bad, good and check."""
    first = rules.groupBy("bad", "good", "check").agg(F.min_by("source", "rule_ord").alias("source"))
    return findings.join(first, ["bad", "good", "check"], "left")


def prompt_matches(docs: DataFrame, rules, text_col: str = "text") -> DataFrame:
    """Rows (doc columns, bad) of rules for prompts whose pattern stands in a text; no mask, no boundary."""
    spark = docs.sparkSession
    rows = [(r[1], "|".join(alternative_pattern(a) for a in alternatives(r[1]))) for r in rules if r[4] == "프롬프트"]
    table = spark.createDataFrame(rows, "bad string, pattern string")
    return docs.join(F.broadcast(table), F.regexp_like(F.col(text_col), F.col("pattern"))).drop("pattern")


def bearable_check(bad: str, good: str, lintable: bool, *, matches_itself: bool, fixes_probe: bool) -> str:
    """치환, 정규식 or 프롬프트: the strongest check that a rule bears.

    matches_itself: the rule is found in its own good; fixes_probe: it repairs a
    plain sentence with bad. Both come from running the rule on one row.
    """
    if not lintable or not alternatives(bad) or len(_strip(bad)) > MAX_PATTERN:
        return "프롬프트"
    weak = len(_strip(bad)) > MAX_SUBSTITUTE or replacement(bad, good) is None or matches_itself or not fixes_probe
    return "정규식" if weak else "치환"


def report_labels(template: Column, mode: Column, n_findings: Column, redacted: Column) -> Column:
    """Label of a report: whether it shows again, or nothing where no scan ran; needs-info after redaction."""
    shows = F.when(template == "missed-expression", n_findings == 0).otherwise(n_findings > 0)
    first = F.when(mode == "lint", F.when(shows, "reproduced").otherwise("not-reproduced"))
    return F.array_compact(F.array(first, F.when(redacted, F.lit("needs-info"))))


def transitions(base: DataFrame, head: DataFrame, base_in: DataFrame, head_in: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows (key, move, changed) of keys on both sides that entered or left the document."""
    flag = lambda df, name: df.select("key").distinct().withColumn(name, F.lit(True))
    rows = base.select("key").distinct().join(head.select("key").distinct(), "key")
    for df, name in ((base_in, "was"), (head_in, "now"), (changed, "changed")):
        rows = rows.join(flag(df, name), "key", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return rows.where("was <> now").select("key", F.when(F.col("now"), "entered").otherwise("left").alias("move"), "changed")


def version(text: Column) -> Column:
    """struct(major, minor, patch), which orders as versions do; null for anything else."""
    t = F.trim(text)
    part = lambda k: F.regexp_extract(t, r"^([0-9]+)\.([0-9]+)\.([0-9]+)$", k).try_cast("int")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def next_version(text: Column, level: Column) -> Column:
    v = version(text)
    join = lambda a, b, c: F.concat_ws(".", a.cast("string"), b.cast("string"), c.cast("string"))
    return F.when(v.isNull(), None).when(level == "minor", join(v["major"], v["minor"] + 1, F.lit(0))).when(level == "patch", join(v["major"], v["minor"], v["patch"] + 1))


def version_problem(head: Column, other: Column, base: Column, subject: Column) -> Column:
    """The first of: invalid-version, version-mismatch, version-not-bumped, subject-format; null where all is well."""
    said = F.regexp_extract(F.trim(F.substring_index(subject, "\n", 1)), "^([0-9]+[.][0-9]+[.][0-9]+) — .+$", 1)
    return (
        F.when(version(head).isNull() | version(other).isNull(), "invalid-version")
        .when(head != other, "version-mismatch")
        .when(version(base).isNotNull() & (version(head) <= version(base)), "version-not-bumped")
        .when((F.coalesce(F.trim(subject), F.lit("")) != "") & (said != head), "subject-format")
    )


CODE = r"(?s)```.*?```|~~~.*?~~~|`[^`\n]*`"


def rewrite_links(markdown: Column, pages: dict[str, str], blob: str) -> Column:
    """Link targets outside code: known documents to their pages, other relative paths to blob; anchors stay."""
    names = F.create_map(*[F.lit(x) for kv in pages.items() for x in kv]) if pages else None

    def target(hit):
        inner = F.regexp_extract(hit, r"^\]\((.*)\)$", 1)
        path, anchor = F.regexp_extract(inner, "^([^#]*)", 1), F.regexp_extract(inner, "(#.*)$", 1)
        path = F.regexp_replace(path, r"^\./", "")
        page = F.try_element_at(names, path) if names is not None else F.lit(None).cast("string")
        keep = (inner == "") | inner.rlike("(?i)^(?:[a-z][a-z0-9+.-]*:|//)") | inner.startswith("#") | (path == "")
        return F.when(keep, hit).otherwise(F.concat(F.lit("]("), F.coalesce(page, F.concat(F.lit(blob), path)), anchor, F.lit(")")))

    code = matches(markdown, CODE)
    links = F.filter(matches(markdown, r"\]\([^()\s]*\)"), lambda m: ~F.exists(code, lambda c: (c["start"] <= m["start"]) & (m["start"] < c["start"] + F.length(c["hit"]))))
    return rebuild(markdown, F.transform(links, lambda m: F.struct(m["start"].alias("start"), F.length(m["hit"]).alias("len"), target(m["hit"]).alias("new"))))


def replace_block(text: Column, begin: str, end: str, body: Column) -> Column:
    """text with what stands between two markers replaced."""
    a = F.locate(begin, text)
    b = F.locate(end, text)
    return F.when((a > 0) & (b > a), F.concat(F.substring(text, F.lit(1), a + len(begin) - 1), body, F.substring(text, b, F.length(text)))).otherwise(text)


def cut_to_bytes(text: Column, limit: int) -> Column:
    """The longest beginning of whole lines within limit bytes of UTF-8."""
    ends = lambda lines: running_sums(F.transform(lines, lambda x: F.octet_length(x) + 1))
    fitting = lambda lines: F.size(F.filter(ends(lines), lambda e: e - 1 <= limit))
    return let(F.split(text, "\n", -1), lambda lines: F.array_join(F.slice(lines, 1, fitting(lines)), "\n"))


def within_size(df: DataFrame, key: str, text_col: str, limit: int = 2_000_000) -> DataFrame:
    """df with fixable: whether all texts of its key together stay within limit characters. Sums are aggregated, texts stay."""
    sizes = df.groupBy(F.col(key).alias("__ts_key")).agg((F.sum(F.coalesce(F.length(text_col), F.lit(0))) <= limit).alias("fixable"))
    return df.drop("fixable").join(sizes, F.col(key).eqNullSafe(F.col("__ts_key"))).drop("__ts_key")


def rank_scores(ranks: DataFrame) -> DataFrame:
    """Points by condition: four for a first place, one for a fourth."""
    return ranks.groupBy("condition").agg(F.sum(5 - F.col("rank")).cast("long").alias("points"))


def section_counts(findings: DataFrame, sections: list[str]) -> DataFrame:
    """One row with a column of counts for each section."""
    return findings.agg(*[F.count_if(F.col("section") == s).alias(s) for s in sections])


def edit_context(file: Column, masked: Column, fragment: Column, mark: str) -> Column:
    """exempt where every place of fragment in file is masked, ok where one is not, unknown where there is none."""
    at = matches_literal(file, fragment)
    shown = lambda m: F.replace(F.substring(masked, m["start"] + 1, F.length(fragment)), F.lit(mark)) != ""
    return F.when(F.size(at) == 0, "unknown").when(F.exists(at, shown), "ok").otherwise("exempt")


def matches_literal(text: Column, literal: Column) -> Column:
    from .positions import matches_of

    quoted = F.concat(F.lit(r"\Q"), literal, F.lit(r"\E"))
    return matches_of(F.split(text, quoted, F.lit(-1)), F.regexp_extract_all(text, quoted, F.lit(0)))
