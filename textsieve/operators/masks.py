"""Masks: parts of a text that are no prose, found on the original and overwritten at equal length."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hangul import SPACE, mostly_non_hangul
from ..shipping import ship
from .positions import SPANS, let, matches, merge_spans, overwrite, running_sums, spans

#: Overwritten characters. Offsets stay.
MARK = "\x01"
IGNORE_FILE = r"<!--\s*textsieve:ignore-file\b[^>]*-->"
INLINE_CODE, TAGS = "`[^`\n]*`", "<[^>\n]{1,200}>"
#: Java counts Hangul as word characters at \b, so the boundary is spelled out.
URLS, URLS_RE2 = r"(?<![A-Za-z0-9_])https?://[^\s]+", r"\bhttps?://[^\s]+"
# Extensions of file names that are masked.
EXTENSIONS = "mjs|cjs|js|ts|tsx|jsx|json|md|py|go|rs|java|kt|rb|sh|bash|zsh|yml|yaml|toml|lock|txt|csv|css|scss|html|sql|env|ini|conf|png|jpe?g|gif|svg|webp|ico|pdf"
PARTICLES = "을|를|이|가|은|는|과|와|도|의|에서|에게|으로|로서|로써|로|까지|부터|이나|나|이란|란"
# What may stand around a name or a path, and the patterns of what is never prose; a scan finds what
# these leave, so their form is part of the result.
LEAD = "(?<![^\\s(\\[\"'「【（])"
TAIL = "(?:[)\\]\"'」】）,.:;!?]*(?:" + PARTICLES + "))?[)\\]\"'」】）,.:;!?]*(?=\\s|$)"
# What is no prose in any format.
ALWAYS = [
    r"(?s)```.*?```",
    r"(?s)~~~.*?~~~",
    INLINE_CODE,
    TAGS,
    URLS,
    r"(?<![A-Za-z0-9_])www\.[^\s)]+",
    r"\$\{?[A-Za-z_][A-Za-z0-9_]*\}?",
    r"(?:(?m)^|\s)--?[A-Za-z][A-Za-z0-9-]*",
    LEAD + rf"[\p{{L}}\p{{N}}_-]+\.(?:{EXTENSIONS})" + TAIL,
    LEAD + r"(?=[A-Za-z0-9_가-힣]*[가-힣])[A-Za-z0-9_가-힣]*_[A-Za-z0-9_가-힣]*" + TAIL,
    r"\]\([^()\]\n]{0,2000}\)",
    r"(?dm)^ {0,3}\[[^\]\n]+\]:[ \t]+\S[^\n]*$",
    r"\$\([^()\n]*\)",
    r"(?s)<!--\s*textsieve:ignore-start\b.*?-->.*?<!--\s*textsieve:ignore-end\b.*?-->",
    r"(?dm)^.*<!--\s*textsieve:ignore\b[^>]*-->.*$",
]
PATHS = LEAD + r"(?:[\p{L}\p{N}_.-]+[/\\][\p{L}\p{N}_./\\-]*|[\p{L}\p{N}_.-]*[/\\][\p{L}\p{N}_./\\-]+)" + TAIL
#: A run of letters and digits in which Hangul meets a Latin word.
JOINED = r"(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]*[가-힣](?:[a-z]|[A-Z][a-z]))[\p{L}\p{N}_]+"
LOG_LINES = r"(?dm)^[ \t]*(?:>[ \t]*)?(?:[-*+][ \t]+)?(?:[A-Z][A-Za-z]*(?:Error|Exception)|[Ee]rror|ERROR|FATAL|[Ff]atal|WARN|WARNING|[Ww]arning|panic|Traceback)(?:\[[^\]\n]*\])?:[ \t][^\n]*"
PROMPTS = r"(?dm)^[ \t]*\$ (?![0-9])[^\n]*"


def without_ignored(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.where(~F.col(text_col).rlike(IGNORE_FILE))


def ranges(text: Column) -> Column:
    """All ranges that are masked whatever the format, merged."""
    found = [spans(matches(text, p)) for p in [*ALWAYS, JOINED, PROMPTS]]
    found.append(spans(F.filter(matches(text, PATHS), lambda m: m["hit"].rlike("[A-Za-z0-9]"))))
    found.append(spans(F.filter(matches(text, LOG_LINES), lambda m: mostly_non_hangul(F.regexp_replace(m["hit"], r"^[^:]*:[ \t]", "")))))
    return merge_spans(F.concat(*found))


def mask(text: Column, extra: Column | None = None) -> Column:
    """text with its ranges, and extra (s, e) ranges, overwritten. All ranges are of the original text.

    A null text is empty: a mask that can't be null is worked out once, where a
    filter against nulls would have it worked out before too.
    """
    found = ranges(text) if extra is None else merge_spans(F.concat(ranges(text), extra))
    return F.coalesce(overwrite(text, found, MARK), F.lit(""))


def apart(rows: DataFrame) -> DataFrame:
    """rows as they are, by Arrow batches: Catalyst would put a mask into every use of it, and a plan of several is more than it can take."""
    ship(rows.sparkSession)
    return rows.mapInArrow(lambda batches: batches, rows.schema)


def masked(docs: DataFrame, text_col: str = "text", out: str = "masked") -> DataFrame:
    """docs with out: the text with the ranges of all formats overwritten."""
    return _overwritten(docs, text_col, None, out, False)


def protected(docs: DataFrame, text_col: str = "text", ext_col: str | None = None, out: str = "masked") -> DataFrame:
    """docs with out: the text with all ranges overwritten, those of its format (ext_col) and of defined labels too.

    Without ext_col a text has no format, as a commit message.
    """
    return apart(_overwritten(docs, text_col, ext_col, out, True))


def _overwritten(docs: DataFrame, text_col: str, ext_col: str | None, out: str, labels: bool) -> DataFrame:
    text, ext = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(ext_col), F.lit("")) if ext_col else None
    rows = docs.withColumns({"__ts_text": text} | ({"__ts_ext": ext} if ext_col else {}))
    return rows.withColumn(out, _mask_column(id(docs.sparkSession.sparkContext._gateway), ext_col is not None, labels)).drop("__ts_text", "__ts_ext")


@lru_cache(maxsize=16)
def _mask_column(gateway: int, formats: bool, labels: bool) -> Column:
    """The mask of the column __ts_text, kept for the JVM it was built in: building it is thousands of calls."""
    text = F.col("__ts_text")
    if not labels:
        return mask(text)
    extra = label_ranges(text)
    return mask(text, F.concat(extra, format_ranges(text, F.col("__ts_ext"))) if formats else extra)


MARKDOWN = ["md", "mdx", "markdown"]
# Front-matter keys whose values are prose; lines that open and close a listing.
PROSE_KEYS = ["title", "description", "summary", "excerpt", "subtitle"]
LISTING_MARKS = ["----", "....", "++++"]
BLANK = f"^{SPACE}*$"
HTML_CODE = [r"(?is)<pre[^>]*>.*?</pre>", r"(?is)<code[^>]*>.*?</code>"]
#: Kinds of line, a letter each, first that fits: blank, list item or other line that is indented like code, fence or
#: heading, list item, text. A block of indented code is then a pattern over the letters of a text.
LINE_KINDS = [("B", BLANK), ("J", r"^(?: {4}|\t)\s*(?:[-*+]|\d+[.)])\s+\S"), ("I", r"^(?: {4}|\t)"), ("M", r"^ {0,3}(?:```|~~~|#{1,6}(?:\s|$))"), ("L", r"^\s*(?:[-*+]|\d+[.)])\s+\S")]
#: After blank lines and no list item, after a fence or heading, or at the beginning; blank lines before count to the match.
CODE_BLOCK = r"(?:(?:^|(?<=[MTI]))B+|^|(?<=M))[IJ](?:B*[IJ])*"
#: Kinds of front-matter line: fence, its other end, key of prose, key in Latin letters, key, blank, more of a value, list, remark.
KEY = r"^[^\s:*#-][^\n:]*:(?=[ \t]|$)"
HEAD_KINDS = [
    ("F", r"^---[ \t]*\r?$"), ("E", r"^\.\.\.[ \t]*\r?$"), ("P", rf"^(?:{'|'.join(PROSE_KEYS)})[ \t]*:(?=[ \t]|$)"),
    ("A", r"^[A-Za-z0-9_][A-Za-z0-9_-]*[ \t]*:(?=[ \t]|$)"), ("K", KEY), ("B", BLANK), ("C", r"^\s+\S"), ("S", r"^-[ \t]"), ("H", "^#"),
]
FRONT_MATTER = "^F([PAK][PAKBCSH]*)[FE]"


def _kinds(lines: Column, kinds: list[tuple[str, str]], other: str) -> Column:
    """A letter for each line, as one string."""

    def kind(line):
        out = F.lit(other)
        for letter, pattern in reversed(kinds):
            out = F.when(line.rlike(pattern), letter).otherwise(out)
        return out

    return F.array_join(F.transform(lines, kind), "")


class _Lines:
    """The lines of a text and where they stand."""

    def __init__(self, lines: Column, ends: Column):
        """ends: where each line ends, its line break with it."""
        self.lines, self.ends = lines, ends

    def begin(self, i: Column) -> Column:
        return F.when(i > 0, F.get(self.ends, i - 1)).otherwise(0)

    def end(self, i: Column) -> Column:
        return F.get(self.ends, i) - 1

    def span(self, first: Column, last: Column) -> Column:
        return F.struct(self.begin(first).alias("s"), self.end(last).alias("e"))


def _with_lines(text: Column, use) -> Column:
    return let(F.split(text, "\n", -1), lambda lines: let(running_sums(F.transform(lines, lambda x: F.length(x) + 1)), lambda ends: use(_Lines(lines, ends))))


def _blocks(lines: Column) -> Column:
    """(before, first, last) of blocks of indented code, by number of line; before: the last line that is not blank, -1 for none."""

    def block(m):
        blanks = F.length(m["hit"]) - F.length(F.ltrim(m["hit"], F.lit("B")))
        return F.struct((m["start"] - 1).alias("before"), (m["start"] + blanks).alias("first"), (m["start"] + F.length(m["hit"]) - 1).alias("last"))

    return let(_kinds(lines, LINE_KINDS, "T"), lambda kinds: F.transform(matches(kinds, CODE_BLOCK), block))


def indented_blocks(text: Column) -> Column:
    """Blocks indented by four spaces or a tab, after a blank line, a fence or a heading, but not in a list."""
    return _with_lines(text, lambda t: F.transform(_blocks(t.lines), lambda b: t.span(b["first"], b["last"])))


def literal_blocks(text: Column) -> Column:
    """reStructuredText: indented blocks after a code directive or a line that ends in two colons, that line with them."""
    opens = lambda line: line.rlike(r"^[ \t]*\.\.[ \t]+(?:code-block|code|sourcecode)::") | line.rlike(r"^[ \t]*\S.*::[ \t]*$")

    def found(t):
        after = F.filter(_blocks(t.lines), lambda b: F.coalesce((b["before"] >= 0) & opens(F.get(t.lines, b["before"])), F.lit(False)))
        return F.transform(after, lambda b: t.span(b["before"], b["last"]))

    return _with_lines(text, found)


def listings(text: Column) -> Column:
    """AsciiDoc: from each odd line of a mark to the next of the same."""

    def found(t):
        def pairs(mark):
            at = F.filter(F.transform(t.lines, lambda x, i: F.when(x.rlike("^" + mark.replace(".", "[.]").replace("+", "[+]") + "[ \t]*$"), i)), lambda i: i.isNotNull())
            return let(at, lambda a: F.filter(F.transform(a, lambda i, k: F.when((k % 2 == 0) & (k + 1 < F.size(a)), t.span(i, F.get(a, k + 1)))), lambda x: x.isNotNull()))

        return F.concat(*map(pairs, LISTING_MARKS))

    return _with_lines(text, found)


def front_matter(text: Column) -> Column:
    """Front matter but for the values of prose keys."""

    def found(t):
        def ranges(kinds):
            body = F.regexp_extract(kinds, FRONT_MATTER, 1)
            # What goes on after a prose key is prose.
            shown = F.split(F.regexp_replace(body, r"(?<=P)C|(?!^)\GC", "V"), "")
            rows = F.transform(shown, lambda k, i: F.when(k == "V", None).when(k == "P", F.struct(t.begin(i + 1).alias("s"), (t.begin(i + 1) + F.locate(":", F.get(t.lines, i + 1))).alias("e"))).otherwise(t.span(i + 1, i + 1)))
            n = F.length(body)
            ends = F.array(F.struct(F.lit(0).alias("s"), t.begin(F.lit(1)).alias("e")), t.span(n + 1, n + 1))
            whole = F.filter(F.concat(rows, ends), lambda r: r["s"] < r["e"])
            return F.when(body.rlike("[PA]"), whole).otherwise(F.array().cast(SPANS))

        return let(_kinds(t.lines, HEAD_KINDS, "X"), ranges)

    return F.when(text.rlike(r"^---[ \t]*\r?\n"), _with_lines(text, found)).otherwise(F.array().cast(SPANS))


def format_ranges(text: Column, ext: Column) -> Column:
    """Ranges that depend on the format (md, rst, adoc) and on the lines before."""
    html = [spans(matches(text, p)) for p in HTML_CODE]
    ext, none = F.lower(ext), F.array().cast(SPANS)
    return F.when(ext.isin(MARKDOWN), F.concat(*html, indented_blocks(text), front_matter(text))).when(ext == "rst", literal_blocks(text)).when(ext == "adoc", listings(text)).otherwise(none)


def label_ranges(text: Column) -> Column:
    """The ranges of reference_labels within one text, as a column; a definition in code does not count."""
    label = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    prose = F.regexp_replace(text, r"(?s)```.*?```|~~~.*?~~~|`[^`\n]*`", MARK)
    defined = F.transform(F.regexp_extract_all(prose, F.lit(r"(?m)^ {0,3}\[([^\]\n]+)\]:[ \t]+\S"), 1), label)
    first, second = lambda m: F.regexp_extract(m["hit"], r"^\[([^\]]*)\]", 1), lambda m: F.regexp_extract(m["hit"], r"\]\[([^\]]*)\]$", 1)
    known = lambda c: F.array_contains(defined, label(c))
    end = lambda m: (m["start"] + F.length(m["hit"])).alias("e")
    two = F.filter(matches(text, r"\[[^\[\]\n]{0,999}\]\[[^\[\]\n]{0,999}\]"), lambda m: known(F.when(second(m) == "", first(m)).otherwise(second(m))))
    one = F.filter(matches(text, r"(?<!\])\[[^\[\]\n]{0,999}\](?![(\[])"), lambda m: known(F.regexp_extract(m["hit"], r"^\[([^\]]*)\]", 1)))
    spans_two = F.transform(two, lambda m: F.struct(F.when(second(m) == "", m["start"]).otherwise(m["start"] + F.length(first(m)) + 2).alias("s"), end(m)))
    return F.when(text.contains("]:"), F.concat(spans_two, spans(one))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def reference_labels(docs: DataFrame, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, s, e) of [text][label], [label][] and [label] whose label the document defines: a semi-join."""
    label = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    defined = docs.select(doc, F.explode(F.regexp_extract_all(text_col, F.lit(r"(?m)^ {0,3}\[([^\]\n]+)\]:[ \t]+\S"), 1)).alias("label")).select(doc, label(F.col("label")).alias("label")).distinct()
    two = docs.select(doc, F.explode(matches(F.col(text_col), r"\[[^\[\]\n]{0,999}\]\[[^\[\]\n]{0,999}\]")).alias("m")).select(doc, "m.*")
    first, second = F.regexp_extract("hit", r"^\[([^\]]*)\]", 1), F.regexp_extract("hit", r"\]\[([^\]]*)\]$", 1)
    two = two.select(doc, label(F.when(second == "", first).otherwise(second)).alias("label"), F.when(second == "", F.col("start")).otherwise(F.col("start") + F.length(first) + 2).alias("s"), (F.col("start") + F.length("hit")).alias("e"))
    one = docs.select(doc, F.explode(matches(F.col(text_col), r"(?<!\])\[[^\[\]\n]{0,999}\](?![(\[])")).alias("m"))
    one = one.select(doc, label(F.expr("substring(m.hit, 2, length(m.hit) - 2)")).alias("label"), F.col("m.start").alias("s"), (F.col("m.start") + F.length("m.hit")).alias("e"))
    return two.unionByName(one).join(defined, [doc, "label"], "left_semi").select(doc, "s", "e")
