"""Findings as a reader sees them, whole-text fixes, imports of rules, and the language of a repository's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import particles
from ..functions.hangul import composed, count_hangul, dense_length
from . import masks, scan
from .identifiers import GLUED, SEPARATED, birth_date, fold, redacted
from .positions import let, matches, rebuild, running_sums
from .stats import classify, hangul_share, strip_noise

# Documents shorter than this say nothing about a language; candidates in order.
MIN_DENSE = 120
CANDIDATES = ["README.md", "README.rst", "CONTRIBUTING.md", "docs/README.md"]


def doc_language(docs: DataFrame) -> DataFrame:
    """Rows (repo, language) of docs (repo, path, text): by the first candidate that is long enough.

    A short document gives way to the next; one that can't be read (null) or
    is mostly no letters ends the search as unknown.
    """
    rank = F.array_position(F.array(*map(F.lit, CANDIDATES)), F.col("path"))
    prose = strip_noise(F.substring("text", 1, 32_768))
    letters = count_hangul(prose) + F.regexp_count(prose, F.lit("[A-Za-z]"))
    rows = docs.withColumns({"rank": rank, "dense": dense_length(prose), "letters": letters, "share": hangul_share(F.col("text"))}).where("rank > 0 AND (text IS NULL OR text <> '')")
    usable = rows.where(F.col("text").isNull() | (F.col("dense") >= MIN_DENSE))
    judged = F.when(F.col("text").isNull() | (F.col("letters") / F.col("dense") < 0.2), "unknown").otherwise(classify(F.col("share"), F.lit(3)))
    found = usable.groupBy("repo").agg(F.min_by(judged, "rank").alias("language"))
    return docs.select("repo").distinct().join(found, "repo", "left").select("repo", F.coalesce("language", F.lit("unknown")).alias("language"))


def answer_kind(name: Column, catch: str, clean: str) -> Column:
    """catch or falsePositive by patterns of file names; null for others."""
    return F.when(name.rlike(catch), "catch").when(name.rlike(clean), "falsePositive")


def fix_texts(docs: DataFrame, rules, *, doc: str = "doc_id", text_col: str = "text", ext_col: str | None = None) -> DataFrame:
    """docs with fixed: particles, then terms, then particles again where a term changed. What is masked stays."""

    def particles_fixed(rows, col):
        rows = masks.apart(particles.with_errors(masks.protected(rows, col, ext_col, "__masked"), "__masked", col, "__errors"))
        return rows, F.coalesce(particles.fix_particles(F.col(col), F.col("__errors")), F.lit(""))

    rows, once = particles_fixed(docs, text_col)
    rows = masks.protected(masks.apart(rows.withColumn("__one", once).drop("__masked", "__errors")), "__one", ext_col, "__masked")
    terms = scan.apply_fixes(rows, rules, doc=doc, text_col="__masked", original="__one")
    rows, again = particles_fixed(masks.apart(terms.drop("__one", "__masked", "changes")), "fixed")
    return rows.withColumn("fixed", F.when(F.col("n_fixed") > 0, again).otherwise(F.col("fixed"))).drop("__masked", "__errors")


def redact_line(line: Column) -> Column:
    """A line with its resident numbers cut down; places hold where nothing folds to a shorter line."""
    clean = fold(line)
    found = F.filter(F.concat(matches(clean, SEPARATED), matches(clean, GLUED)), lambda m: birth_date(m["hit"]).isNotNull())
    changes = F.transform(F.array_sort(found), lambda m: F.struct(m["start"].alias("start"), F.length(m["hit"]).alias("len"), redacted(m["hit"]).alias("new")))
    return F.when(F.size(found) == 0, line).otherwise(rebuild(clean, changes))


def findings_by_line(docs: DataFrame, rules, *, doc: str = "doc_id", text_col: str = "masked") -> DataFrame:
    """Findings with line, col (from 1), the redacted line, and replacement where a fix applies.

    Line starts and findings of a document are put in order by place; each finding
    takes the last line start before it. Only texts with findings are moved.
    """
    found = scan.lint(docs, rules, doc=doc, text_col=text_col)
    fixes = scan.apply_fixes(docs.select(doc, text_col), rules, doc=doc, text_col=text_col).select(doc, F.explode("changes").alias("c")).select(doc, F.col("c.start").alias("start"), F.col("c.new").alias("fix"))
    rows = found.drop("replacement").join(fixes, [doc, "start"], "left").select(doc, F.col("start").alias("at"), F.lit(1).alias("turn"), "bad", "good", "matched", "fix")
    texts = docs.select(doc, F.coalesce(let(F.col(text_col), composed), F.lit("")).alias("text")).join(found.select(doc).distinct(), doc, "left_semi")
    lines = texts.select(doc, F.split("text", "\n", -1).alias("lines")).withColumn("ends", running_sums(F.transform("lines", lambda x: F.length(x) + 1)))
    lines = lines.select(doc, F.posexplode(F.arrays_zip("lines", "ends")).alias("n", "z")).select(doc, (F.col("z.ends") - F.length("z.lines") - 1).alias("at"), F.lit(0).alias("turn"), F.struct((F.col("n") + 1).cast("long").alias("line"), (F.col("z.ends") - F.length("z.lines") - 1).alias("begin"), F.col("z.lines").alias("text")).alias("own"))
    before = Window.partitionBy(doc).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.unionByName(lines, allowMissingColumns=True).withColumn("own", F.last("own", True).over(before)).where("turn = 1")
    line = F.col("own.text")
    return rows.select(doc, F.col("own.line").alias("line"), (F.col("at") - F.col("own.begin") + 1).cast("long").alias("col"), "bad", "good", "matched", F.col("fix").isNotNull().alias("fixable"), F.col("fix").alias("replacement"), redact_line(line).alias("line_text"), (redact_line(line) != line).alias("has_pii"))


def line_suggestions(findings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows (doc, line, suggestion): the line with its fixes; none where it has personal data or no fix."""
    item = F.struct((F.col("col") - 1).cast("int").alias("start"), F.length("matched").alias("len"), F.col("replacement").alias("new"))
    rows = findings.groupBy(doc, "line").agg(F.first("line_text").alias("text"), F.bool_or("has_pii").alias("pii"), F.array_sort(F.collect_list(F.when(F.col("fixable"), item))).alias("fixes"))
    return rows.where(~F.col("pii") & (F.size("fixes") > 0)).select(doc, "line", rebuild(F.col("text"), F.col("fixes")).alias("suggestion"))


def import_rules(raw: DataFrame, categories: list[str]) -> DataFrame:
    """New rules of known categories: cells escaped, the first of each bad, none without a change."""
    cell = lambda c: F.trim(F.regexp_replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", " "))
    rows = raw.where(F.col("category").isin(categories)).select("ord", "category", cell("bad").alias("bad"), cell("good").alias("good"), F.when(F.col("priority").isin("핵심", "참고"), F.col("priority")).otherwise("보통").alias("priority"))
    rows = rows.where((F.col("bad") != "") & (F.col("good") != "") & (F.col("bad") != F.col("good")))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("bad").orderBy("ord"))).where("n = 1").drop("n")


def rules_in_text(rules: DataFrame, body: Column) -> DataFrame:
    """Rules whose table row begins as it does in body."""
    start = F.concat(F.lit("| "), F.when(F.coalesce("en", F.lit("")) == "", "—").otherwise(F.col("en")), F.lit(" | "), F.col("bad"), F.lit(" | "), F.col("good"), F.lit(" | "))
    return rules.where(F.contains(body, start))


def issue_values(fields: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """One row a key, a column for each name; a label that is missing is empty."""
    got = fields.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("m"))
    return got.select(key, *[F.coalesce(F.try_element_at("m", F.lit(label)), F.lit("")).alias(name) for name, label in names.items()])
