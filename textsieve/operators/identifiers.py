"""Resident numbers in free text: detection by line, birth dates, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hangul import normalize_width
from .positions import matches, rebuild

ALLOW = "textsieve:allow-rrn"
SEPARATED = r"(?<![0-9])(?<![0-9]\.)[0-9]{6}(?: ?- ?| {1,2})[1-8][0-9]{6}(?![0-9A-Za-z_])"
GLUED = r"(?<![0-9A-Za-z_.])[0-9]{6}[1-8][0-9]{6}(?![0-9A-Za-z_])"
PATH = r"(?<![0-9A-Za-z_.])[0-9]{6} ?- ?[1-8][0-9]{6}(?![0-9A-Za-z_])"
#: A key that holds a time, before a glued number.
TIME_WORD = r"(?i)^(?:time|date|timestamp|stamp|epoch|created|updated|expires|modified|issued|deleted)(?:_?(?:at|on|ms|time|stamp|utc))?$|^ts$|^[a-z0-9_]+_at$"
TIME_CAMEL = r"^[a-z][A-Za-z0-9]*At$"
# Dashes, spaces and digits that fold to ASCII.
DASHES = "－‐‑‒–—−﹣"
SPACES = "\t\x0b\x0c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{2060}\x{AD}\x{FEFF}]"
ARABIC = "٠١٢٣٤٥٦٧٨٩"
FULL = "０１２３４５６７８９"


def fold(line: Column) -> Column:
    """One character for each of line's, but zero-width ones, which go."""
    out = F.translate(line, DASHES + SPACES + ARABIC + FULL, "-" * len(DASHES) + " " * len(SPACES) + "0123456789" * 2)
    return F.regexp_replace(out, ZERO_WIDTH, "")


def century(digit: Column) -> Column:
    return F.when(digit.isin("1", "2", "5", "6"), 1900).when(digit.isin("3", "4", "7", "8"), 2000)


def birth_date(number: Column) -> Column:
    """The date of a 13-digit number; null where there is no such date."""
    d = F.regexp_replace(number, "[^0-9]", "")
    year = century(F.substring(d, 7, 1)) + F.substring(d, 1, 2).try_cast("int")
    return F.try_to_date(F.concat(year.cast("string"), F.substring(d, 3, 4)), "yyyyMMdd")


def time_key_before(prefix: Column) -> Column:
    key = F.regexp_extract(prefix, r"""([A-Za-z0-9_]+)["']? *[:=] *["']?$""", 1)
    return (key != "") & ~key.rlike("(?i)birth") & (key.rlike(TIME_WORD) | key.rlike(TIME_CAMEL))


def resident_numbers(docs: DataFrame, doc: str = "doc_id", text_col: str = "text", *, path_only: bool = False, ignore_allow_line: bool = False) -> DataFrame:
    """Rows (doc, line, col, len, matched); line and col from 1, in code points of the line."""
    lines = docs.select(doc, F.posexplode(F.split(text_col, "\n", -1)).alias("n", "raw"))
    if not ignore_allow_line:
        lines = lines.where(~F.col("raw").contains(ALLOW))
    lines = lines.withColumn("clean", fold(F.col("raw"))).where(F.col("clean").rlike("[0-9]{6}"))
    found = matches(F.col("clean"), PATH if path_only else SEPARATED)
    if not path_only:
        glued = F.filter(matches(F.col("clean"), GLUED), lambda m: ~time_key_before(F.substring(F.col("clean"), F.lit(1), m["start"])))
        found = F.concat(found, glued)
    hits = lines.select(doc, "n", "raw", "clean", F.explode(F.filter(found, lambda m: birth_date(m["hit"]).isNotNull())).alias("m"))
    # Where zero-width characters went, places are those of the raw line: count its visible characters.
    shifted = F.length("raw") != F.length("clean")
    nth = lambda k: F.length(F.regexp_substr(F.col("raw"), F.concat(F.lit(rf"^(?:{ZERO_WIDTH}*[^\x{{200B}}-\x{{200D}}\x{{2060}}\x{{AD}}\x{{FEFF}}]){{"), k.cast("string"), F.lit("}"))))
    start = F.when(shifted, nth(F.col("m.start") + 1) - 1).otherwise(F.col("m.start"))
    end = F.when(shifted, nth(F.col("m.start") + F.length("m.hit"))).otherwise(F.col("m.start") + F.length("m.hit"))
    return hits.select(doc, (F.col("n") + 1).cast("long").alias("line"), (start + 1).cast("long").alias("col"), (end - start).cast("long").alias("len"), F.col("m.hit").alias("matched"))


def redacted(number: Column) -> Column:
    d = F.regexp_replace(normalize_width(number), "[^0-9]", "")
    return F.when(F.length(d) == 13, F.concat(F.substring(d, 1, 6), F.lit("-*******"))).otherwise(F.repeat(F.lit("*"), F.length(number)))


def redact(docs: DataFrame, doc: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with each resident number of text cut down to its birth date."""
    found = resident_numbers(docs, doc, text_col, **options)
    per = found.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("line", "col", "len", "matched"))).alias("__hits"))
    lines = F.split(text_col, "\n", -1)

    def line(s, i):
        own = F.filter("__hits", lambda h: h["line"] == i + 1)
        return F.when(F.size(own) == 0, s).otherwise(rebuild(s, F.transform(own, lambda h: F.struct((h["col"] - 1).cast("int").alias("start"), h["len"].cast("int").alias("len"), redacted(h["matched"]).alias("new")))))

    rows = docs.join(per, doc, "left")
    return rows.withColumn(text_col, F.when(F.col("__hits").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(lines, line), "\n"))).drop("__hits")
