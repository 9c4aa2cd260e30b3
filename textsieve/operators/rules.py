"""Rule tables: reading, checking, and what is worked out once for each rule."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hangul import FIRST, LAST
from ..functions.particles import HEADS

# Fixed values of the table format.
CHECKS = ["치환", "정규식", "프롬프트"]
SCANNED = CHECKS[:2]
PRIORITIES = ["핵심", "보통", "참고"]
KINDS = {"[표기] ": "orthography", "[외래어] ": "loanword"}
HEADER = "원어"
EMPTY = ["—", "-", "–", ""]
WILDCARD, SEPARATOR = "~", " / "
VERB_STEMS = ("시키", "하", "되")
CLAUSE_MARKERS = "을를이가게"
CLAUSE_EXCEPTIONS = {"허가", "판박이", "욕심쟁이", "눈송이", "알갱이"}
NO_JEOK = {"접속면", "연결면"}
META = re.compile(r"생략|또는|참조|문맥|\.{3}|…")

COLUMNS = "en string, bad string, good string, why string, check string, priority string, kind string, source string, rule_ord int"

#: A small set that has every branch; users bring tables of the same form.
RULES = [
    ("", "되어지다", "되다", "겹친 피동", "치환", "핵심", None, "base"),
    ("", "~에 대하여 ~", "~을", "군더더기", "정규식", "보통", None, "base"),
    ("via", "을 통하여", "으로", "번역 말투", "정규식", "보통", None, "base"),
    ("leverage", "레버리지", "활용", "업계 말", "치환", "핵심", None, "terms"),
    ("issue", "이슈", "문제", "업계 말", "치환", "보통", None, "terms"),
    ("needs", "니즈", "요구", "업계 말", "치환", "보통", None, "terms"),
    ("align", "얼라인 / 얼라인먼트", "맞춤", "업계 말", "정규식", "참고", None, "terms"),
    ("", "몇일", "며칠", "맞춤법", "치환", "핵심", "orthography", "spelling"),
    ("", "3가지", "세 가지", "수 표기", "치환", "참고", None, "spelling"),
    ("contents", "컨텐츠", "콘텐츠", "외래어 표기", "치환", "핵심", "loanword", "spelling"),
    ("", "문제를 해결하", "풀", "말투", "정규식", "참고", None, "base"),
    ("", "가져가~것", "하기", "말투", "정규식", "참고", None, "base"),
    ("", "데이터베이스", "데이터베이스", "말투", "프롬프트", "참고", None, "base"),
]


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rules)], COLUMNS)


def read_rule_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of all *.md tables of a folder, in order of file name and row; see parse_tables."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(folder)
    return parse_tables(files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("source"), F.col("value").alias("text")))


def parse_tables(files: DataFrame) -> DataFrame:
    """Rules of (source, text), with valid: rows that break the format have valid = false.

    A row has six cells at least: en, bad, good, why, check, priority. Escaped
    pipes stay in their cell. A dash is an empty cell. A tag before why is kind.
    """
    rows = files.select("source", F.posexplode(F.split("text", "\n", -1)).alias("line", "row")).withColumn("row", F.trim("row")).where(F.col("row").startswith("|"))
    inner = F.regexp_replace(F.regexp_replace(F.replace("row", F.lit("\\|"), F.lit("\x01")), r"^\|", ""), r"\|$", "")
    cells = F.transform(F.split(inner, r"\|", -1), lambda c: F.trim(F.replace(c, F.lit("\x01"), F.lit("|"))))
    rows = rows.withColumn("cells", cells).where(~F.forall("cells", lambda c: c.rlike("^:?-{2,}:?$")) & (F.get("cells", F.lit(0)) != HEADER))
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    plain = lambda i: F.when(cell(i).isin(EMPTY), "").otherwise(cell(i))
    kind, why = F.lit(None).cast("string"), plain(3)
    for tag, name in KINDS.items():
        kind = F.when(plain(3).startswith(tag), name).otherwise(kind)
        why = F.when(plain(3).startswith(tag), F.right(plain(3), F.length(plain(3)) - len(tag))).otherwise(why)
    valid = (F.size("cells") >= 6) & cell(4).isin(CHECKS) & cell(5).isin(PRIORITIES) & (cell(1) != "") & (cell(2) != "")
    return rows.select("source", "line", plain(0).alias("en"), cell(1).alias("bad"), cell(2).alias("good"), why.alias("why"), kind.alias("kind"), cell(4).alias("check"), cell(5).alias("priority"), valid.alias("valid"))


def _strip(text: str) -> str:
    return text.strip().strip(WILDCARD)


def alternatives(bad: str) -> list[str]:
    core = _strip(bad)
    return [a.strip() for a in core.split(SEPARATOR) if a.strip()] or ([core] if core else [])


def alternative_pattern(alt: str) -> str:
    return r"[^\n]{0,20}".join(_quote(p) for p in alt.split(WILDCARD))


def _quote(text: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text)


def primary_good(good: str) -> str:
    """The first way to say it, without remarks in parentheses."""
    text = re.sub(r"\s*\([^)]*\)\s*", " ", _strip(good))
    return re.sub(r"\s+", " ", re.split(r"\s*[/|,]\s*", text)[0]).strip()


def replacement(bad: str, good: str) -> str | None:
    """What a fix may put in place of bad; null where it takes a person to decide."""
    if META.search(good) or WILDCARD in _strip(bad) or len(alternatives(bad)) > 1:
        return None
    text = primary_good(good)
    if not text or WILDCARD in text or re.search(r"[(),/|]", text):
        return None
    if good.lstrip().startswith(WILDCARD) and text[0] in HEADS:
        return None
    return text


def _hangul(ch: str) -> bool:
    return bool(re.match("[가-힣ㄱ-ㅎㅏ-ㅣ]", ch))


def rule_alternatives(rules) -> list[dict]:
    """One record for each alternative of each scanned rule: pattern and what must stand around a match."""
    out = []
    for i, (en, bad, good, why, check, priority, kind, source) in enumerate(rules):
        if check not in SCANNED:
            continue
        alts = alternatives(bad)
        for n, alt in enumerate(alts):
            if len(re.sub(r"\s", "", alt.replace(WILDCARD, ""))) < 2:
                continue
            words = alt.split()
            lead = bad.strip().startswith(WILDCARD) and n == 0
            trail = bad.strip().endswith(WILDCARD) and n == len(alts) - 1
            clause = len(words) > 1 and words[-2] not in CLAUSE_EXCEPTIONS and words[-2][-1] in CLAUSE_MARKERS
            digits, good_digits = re.match(r"[0-9]*", alt)[0], re.match(r"[0-9]*", primary_good(good))[0]
            out.append({
                "rule_ord": i, "alt_ord": n, "bad": bad, "good": good, "check": check, "priority": priority, "source": source, "alt": alt,
                "pattern": alternative_pattern(alt), "literal": max(alt.split(WILDCARD), key=len), "wild": WILDCARD in alt,
                "left": kind not in KINDS.values() and not lead and _hangul(alt[0]),
                "left_digit": not lead and digits != "" and digits != good_digits,
                "right": kind != "loanword" and not trail and not alt.endswith(VERB_STEMS) and not clause and _hangul(alt[-1]),
                "allow_jeok": sum(FIRST <= ord(c) <= LAST for c in words[-1]) >= 3 and words[-1] not in NO_JEOK,
                "replacement": replacement(bad, good),
            })
    return out


ALT_SCHEMA = "rule_ord int, alt_ord int, bad string, good string, check string, priority string, source string, alt string, pattern string, literal string, wild boolean, left boolean, left_digit boolean, right boolean, allow_jeok boolean, replacement string"


def alternatives_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = rule_alternatives(rules)
    names = [c.split()[0] for c in ALT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ALT_SCHEMA)


def diff_rules(base: DataFrame, head: DataFrame) -> DataFrame:
    """Rows (source, bad, change, columns): added, removed and changed rules; of equal keys the last counts."""
    cols = ["en", "good", "why", "check", "priority", "kind"]
    last = lambda df: df.groupBy("source", "bad").agg(F.max_by(F.struct(*cols), "rule_ord").alias("r"))
    both = last(base).withColumnRenamed("r", "b").join(last(head).withColumnRenamed("r", "h"), ["source", "bad"], "full")
    differs = F.filter(F.array(*[F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"h.{c}")), c) for c in cols]), lambda c: c.isNotNull())
    change = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.size(differs) > 0, "changed")
    columns = F.when(change == "changed", F.array_join(differs, ",")).otherwise("")
    return both.select("source", "bad", change.alias("change"), columns.alias("columns")).where(F.col("change").isNotNull())
