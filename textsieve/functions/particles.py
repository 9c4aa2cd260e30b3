"""Particles after Latin words and numbers, judged by how these are read; unknown readings are not judged."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.positions import matches, rebuild
from .hangul import final_sound

# Pairs of particles, after a final first; longer forms before their beginnings.
PAIRS = [
    ("으로서", "로서"), ("으로써", "로써"), ("으로", "로"), ("이나", "나"), ("이란", "란"), ("이라", "라"), ("이며", "며"), ("이든", "든"),
    ("이어야", "여야"), ("이어서", "여서"), ("이었", "였"), ("이에요", "예요"), ("이랑", "랑"), ("을", "를"), ("이", "가"), ("은", "는"), ("과", "와"),
]
#: Final sounds of 0 to 9, read in Korean and in English.
DIGITS_KOREAN = ["other", "ㄹ", "", "other", "", "", "other", "ㄹ", "ㄹ", ""]
DIGITS_ENGLISH = ["", "other", "", "", "", "", "", "other", "", "other"]
LETTERS = {"l": "ㄹ", "r": "ㄹ", "m": "other", "n": "other"}
#: Acronyms with a vowel that are spelled out all the same.
SPELLED = ["API", "URL", "CPU", "GPU", "UI", "UX", "ID", "OS", "CI", "QA", "AWS", "CLI", "IDE", "IP", "RAM", "USB", "UUID", "ORM", "DOM"]
#: Readings of words; a table of the same form can be given instead.
LEXICON = {
    "json": "other", "commit": "other", "hook": "other", "stack": "other", "token": "other", "button": "other", "login": "other", "plugin": "other",
    "docker": "", "server": "", "cache": "", "merge": "", "branch": "", "push": "", "query": "", "code": "", "test": "", "index": "", "batch": "", "data": "",
    "file": "ㄹ", "table": "ㄹ", "email": "ㄹ", "model": "ㄹ", "label": "ㄹ", "script": "", "thread": "", "spark": "", "python": "other", "join": "other",
}
#: After a bare number these can also be something else.
NOT_AFTER_NUMBERS = ["이어야", "여야", "이어서", "여서"]
ALL = sorted({p for pair in PAIRS for p in pair}, key=lambda p: (-len(p), p))
HEADS = "".join(sorted({p[0] for pair in PAIRS for p in pair}))
IN_ORDER = list(dict.fromkeys(p for pair in PAIRS for p in pair))
TOKEN = "([A-Za-z][A-Za-z0-9]*|[0-9]+)(" + "|".join(IN_ORDER) + ")(?![가-힣])"
PAREN = r"([가-힣]+|[A-Za-z0-9]+)\(([^()]+)\)(" + "|".join(IN_ORDER) + ")(?![가-힣])"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def word_final_sound(word: Column, lexicon: dict[str, str] | None = None) -> Column:
    """Final sound of a Latin word, acronym or number; null where its reading is unknown."""
    known = F.element_at(_map(lexicon or LEXICON), F.lower(word))
    tail = F.regexp_extract(word, "([0-9]+)$", 1)
    digit = F.try_cast(F.right(word, F.lit(1)), "int") if hasattr(F, "try_cast") else F.right(word, F.lit(1)).try_cast("int")
    pick = lambda t: F.element_at(F.array(*map(F.lit, t)), digit + 1)
    numbered = F.when(~word.rlike("[A-Za-z]"), pick(DIGITS_KOREAN)).when(F.length(tail) == 1, pick(DIGITS_ENGLISH))
    spelled = word.rlike("^[A-Z]{2,4}$") & (~word.rlike("[AEIOU]") | word.isin(SPELLED))
    letter = F.coalesce(F.element_at(_map(LETTERS), F.lower(F.right(word, F.lit(1)))), F.lit(""))
    return F.when(known.isNotNull(), known).when(F.length(tail) > 0, numbered).when(spelled, letter)


def for_final(final: Column, particle: Column) -> Column:
    """The form that final asks for; null where particle already is it, or final is null."""
    long_of, short_of = _map({p: a for a, b in PAIRS for p in (a, b)}), _map({p: b for a, b in PAIRS for p in (a, b)})
    short = (final == "") | ((final == "ㄹ") & F.element_at(short_of, particle).startswith("로"))
    right = F.when(short, F.element_at(short_of, particle)).otherwise(F.element_at(long_of, particle))
    return F.when(final.isNotNull() & (right != particle), right)


def correct_particle(word: Column, particle: Column, lexicon: dict[str, str] | None = None) -> Column:
    ambiguous = word.rlike("^[0-9]+$") & particle.isin(NOT_AFTER_NUMBERS)
    return F.when(~ambiguous, for_final(word_final_sound(word, lexicon), particle))


def particle_errors(masked: Column, original: Column | None = None, lexicon: dict[str, str] | None = None) -> Column:
    """Array of (start, matched, word, particle, correct), by start. start counts from 0."""
    original = masked if original is None else original
    group = lambda m, pattern, k: F.regexp_extract(m, pattern, k)

    def plain(m):
        w, p = group(m["hit"], TOKEN_ALONE, 1), group(m["hit"], TOKEN_ALONE, 2)
        return F.struct(m["start"].alias("start"), m["hit"].alias("matched"), w.alias("word"), p.alias("particle"), correct_particle(w, p, lexicon).alias("correct"))

    def paren(m):
        head, p = group(m["hit"], PAREN_ALONE, 1), group(m["hit"], PAREN_ALONE, 3)
        last = F.right(head, F.lit(1))
        final = F.when(head.rlike("^[가-힣]"), final_sound(last)).when(~head.rlike("^[0-9]+$"), word_final_sound(head, lexicon))
        text = F.substring(original, m["start"] + 1, F.length(m["hit"]))
        word = F.substring(text, F.lit(1), F.length(m["hit"]) - F.length(p))
        return F.struct(m["start"].alias("start"), text.alias("matched"), word.alias("word"), p.alias("particle"), for_final(final, p).alias("correct"))

    both = F.concat(F.transform(matches(masked, TOKEN), plain), F.transform(matches(masked, PAREN), paren))
    return F.array_sort(F.filter(both, lambda e: e["correct"].isNotNull()))


def with_errors(docs: DataFrame, masked_col: str, text_col: str, out: str) -> DataFrame:
    """docs with out: particle_errors of two columns, by an expression that is built once for a JVM."""
    rows = docs.withColumns({"__ts_masked": F.col(masked_col), "__ts_text": F.col(text_col)})
    return rows.withColumn(out, _errors_column(id(docs.sparkSession.sparkContext._gateway))).drop("__ts_masked", "__ts_text")


@lru_cache(maxsize=4)
def _errors_column(gateway: int) -> Column:
    return particle_errors(F.col("__ts_masked"), F.col("__ts_text"))


#: A match alone has nothing after it, so the look-ahead holds.
TOKEN_ALONE, PAREN_ALONE = f"^{TOKEN}", f"^{PAREN}"


def fix_particles(text: Column, errors: Column) -> Column:
    """text with the particle of each error replaced, in one pass."""
    return rebuild(text, F.transform(errors, lambda e: F.struct((e["start"] + F.length(e["word"])).alias("start"), F.length(e["particle"]).alias("len"), e["correct"].alias("new"))))
