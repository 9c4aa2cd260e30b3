"""Language, style and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hangul import count_hangul
from .positions import matches

# Latin verbs that have a settled Hangul form, and the endings they take.
VERBS = {
    "push": "푸시", "merge": "머지", "rebase": "리베이스", "deploy": "배포", "call": "호출", "update": "업데이트", "fix": "수정", "commit": "커밋", "build": "빌드",
    "run": "실행", "test": "테스트", "review": "리뷰", "refactor": "리팩터링", "handle": "처리", "install": "설치", "reset": "리셋", "apply": "적용", "release": "릴리스",
    "trigger": "트리거", "iterate": "순회", "parse": "파싱", "validate": "검증", "sync": "동기화", "save": "저장", "create": "생성", "send": "전송",
}
ENDINGS = ["합니다", "하세요", "됩니다", "하도록", "하려면", "하다", "하는", "하고", "하면", "해서", "하기", "하여", "되는", "되면", "되고", "되어", "하지", "하게", "되지", "한", "할", "해", "했", "된", "돼", "됐", "됨", "함"]
_longest = lambda names: "|".join(sorted(names, key=lambda n: (-len(n), n)))
#: The look-behind is bounded: Java takes unbounded ones and then misjudges them.
LATIN_VERB = r"(?i)(?<![A-Za-z0-9_.:/@$\\\x01-])(?<![A-Za-z0-9\x01]{1,64}[ \t])(" + _longest(VERBS) + ")(" + _longest(ENDINGS) + ")"


def latin_verbs(masked: Column) -> Column:
    """Array of (start, hit, good): a Latin verb with a Korean ending, and its Hangul form."""
    names = F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv])
    inner = "(?i)^(" + _longest(VERBS) + ")(.*)$"

    def good(m):
        return F.struct(m["start"].alias("start"), m["hit"].alias("hit"), F.concat(F.element_at(names, F.lower(F.regexp_extract(m["hit"], inner, 1))), F.regexp_extract(m["hit"], inner, 2)).alias("good"))

    return F.transform(matches(masked, LATIN_VERB), good)


# Subjects that tools write, one pattern each; the share of a language rests on what they leave out.
BOT_SUBJECTS = [
    r"(?i)^merge(?![A-Za-z0-9_])", r"(?i)^revert(?![A-Za-z0-9_])", "(?i)^initial commit$", r"(?i)^(?:update|create|delete)\s+\S+\.\w+$",
    r"(?i)^(?:\w+(?:\([^)]*\))?!?:\s*)?bump\s+\S.*\s+from\s+\S.*\s+to\s+\S", r"(?i)^(?:\w+(?:\([^)]*\))?!?:\s*)?update dependency\s",
    r"(?i)^(?:\w+(?:\([^)]*\))?!?:\s*)?update module\s",
]


def meaningful(subject: Column) -> Column:
    """A subject that a person wrote in some language."""
    latin = F.regexp_count(subject, F.lit("[A-Za-z]"))
    bots = F.lit(False)
    for p in BOT_SUBJECTS:
        bots = bots | subject.rlike(p)
    return (F.trim(subject) != "") & ~subject.rlike("[�\\x00]") & ~bots & ((count_hangul(subject) > 0) | (latin >= 3))


def korean_subject(subject: Column) -> Column:
    n = count_hangul(subject)
    return (n >= 2) | ((n == 1) & (F.regexp_count(subject, F.lit("[A-Za-z]")) < 3))


def classify(share: Column, n: Column) -> Column:
    return F.when(share.isNull() | (n < 3), "unknown").when(share >= 0.6, "korean").when(share <= 0.1, "english").otherwise("mixed")


def language_by(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """Share of Korean subjects among meaningful ones, by key."""
    rows = docs.where(meaningful(F.col(text_col))).groupBy(key).agg(F.avg(korean_subject(F.col(text_col)).cast("int")).alias("share"), F.count(F.lit(1)).alias("n_samples"))
    return rows.select(key, F.round("share", 6).alias("share"), "n_samples", classify(F.col("share"), F.col("n_samples")).alias("language"))


def strip_noise(text: Column) -> Column:
    """Prose of a Markdown text; an unclosed fence ends it. The patterns and their order are fixed: shares are of what they leave."""
    t = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    n = F.regexp_count(t, F.lit(r"(?dm)^(?:```|~~~)"))
    t = F.when(F.pmod(n, F.lit(2)) == 1, F.regexp_replace(t, r"(?sdm)^(?:```|~~~)(?!.*^(?:```|~~~)).*\z", "")).otherwise(t)
    for p in (r"(?s)```.*?```", r"(?s)~~~.*?~~~", r"`[^`\n]*`"):
        t = F.regexp_replace(t, p, " ")
    t = F.array_join(F.transform(F.split(t, "\n", -1), lambda s: F.when(s.rlike(r"^(?: {4,}|\t)") & (count_hangul(s) == 0), "").otherwise(s)), "\n")
    t = F.regexp_replace(t, r"<[^>\n]{0,300}>", " ")
    t = F.regexp_replace(t, r"!\[[^\]\n]{0,300}\]\([^)\n]{0,500}\)", " ")
    t = F.regexp_replace(t, r"\[([^\]\n]{0,300})\]\([^)\n]{0,500}\)", "$1")
    return F.regexp_replace(t, r"https?://\S+", " ")


def hangul_share(text: Column, limit: int = 32_768) -> Column:
    """Hangul against Hangul and weighted Latin letters, in the prose of the first limit characters."""
    prose = strip_noise(F.substring(text, 1, limit))
    h, latin = count_hangul(prose), F.regexp_count(prose, F.lit("[A-Za-z]"))
    return F.when(h + latin == 0, F.lit(0.0)).otherwise(h / (h + latin / 2.5))


def style(docs: DataFrame, doc: str, text_col: str) -> DataFrame:
    """Sentences, list items and their endings, one row for each document."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(text_col, r"(?s)<!--.*?-->", ""), r"(?s)```.*?```", ""), "`[^`]*`", "X")
    rows = docs.select(doc, clean.alias("clean"))
    lines = rows.select(doc, F.explode(F.split("clean", "\n", -1)).alias("line")).withColumn("line", F.trim("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").rlike(r"^(?:#|\||[-*_]{3,}$)"))
    item = r"^(?:[-*•]|\d+[.)])\s+"
    said = lines.select(doc, F.col("line").rlike(item).alias("item"), F.explode(F.split(F.regexp_replace(F.regexp_replace("line", item, ""), r"\*\*", ""), r"(?<=[.!?])\s+", -1)).alias("s"))
    said = said.withColumn("s", F.regexp_replace("s", r"[.!?:)\]\"'”’\s]+$", "")).withColumn("n", count_hangul(F.col("s"))).where("n >= 4")
    last = F.element_at(F.regexp_extract_all("s", F.lit("[가-힣]"), 0), -1)
    ended = last.isin("다", "요", "죠", "까", "네")
    noun = F.col("s").rlike("(?:함|됨|음|임|필요|완료|예정|가능|불가|없음|있음|확인|통과|수정|추가|제거|변경|적용|누락)$")
    per = said.groupBy(doc).agg(F.count_if(~F.col("item")).alias("prose"), F.count_if(~F.col("item") & ~ended).alias("prose_no_ending"), F.count_if("item").alias("items"), F.count_if(F.col("item") & ~ended).alias("items_no_ending"), F.count_if(noun).alias("noun_endings"), F.round(F.avg("n"), 1).alias("mean_length"))
    base = rows.select(doc, F.regexp_count("clean", F.lit("—")).cast("long").alias("dashes"), F.round(F.regexp_count("clean", F.lit(r"[가-힣]의(?=\s)")) / F.greatest(count_hangul(F.col("clean")), F.lit(1)) * 1000, 1).alias("ui_per_1000"))
    return base.join(per, doc, "left").fillna(0)


def latency_summary(samples: DataFrame) -> DataFrame:
    """Median and nearest-rank 90th percentile of (payload, side, iter, ms), warm-up runs dropped."""
    rows = samples.where("iter >= 2").groupBy("payload", "side").agg(F.median("ms").alias("median"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY ms)").alias("p90"), F.count(F.lit(1)).alias("n"))
    return rows


def is_regression(base: Column, head: Column) -> Column:
    """Ten ms and a fifth more; nothing to compare with counts as more."""
    d = head - base
    return F.coalesce(~F.isnan(d) & (d >= 10) & ((base <= 0) | (d / base >= 0.2)), F.lit(False))
