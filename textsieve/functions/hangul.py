"""Column functions over Hangul text. Offsets and lengths are in code points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The jamo in Unicode order.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MEDIALS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = ["", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"]
FIRST, LAST = 0xAC00, 0xD7A3
HANGUL = "[가-힣ᄀ-ᇿ㄰-㆏]"
#: White space as JavaScript's \s has it; Java's lacks the non-ASCII ones.
SPACE = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def count_hangul(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(HANGUL)), F.lit(0))


def dense_length(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(text, SPACE, ""))


def looks_korean(text: Column) -> Column:
    """Three Hangul characters or more, and a tenth of those that are not white space."""
    n = count_hangul(text)
    return F.coalesce((n >= 3) & (n / F.greatest(dense_length(text), F.lit(1)) >= 0.1), F.lit(False))


def mostly_non_hangul(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return (letters == 0) | (F.regexp_count(text, F.lit("[가-힣]")) / F.greatest(letters, F.lit(1)) < 0.3)


def _index(ch: Column) -> Column:
    """Place among the syllables; null for anything else."""
    code = F.ascii(ch)
    return F.when((F.length(ch) > 0) & code.between(FIRST, LAST), code - FIRST)


def final_sound(ch: Column) -> Column:
    """'' for no final, 'ㄹ', 'other'; null where ch is no syllable."""
    k = F.pmod(_index(ch), F.lit(28))
    return F.when(k == 0, "").when(k == 8, "ㄹ").when(k.isNotNull(), "other")


def decompose(ch: Column) -> Column:
    """struct(initial, medial, final); null where ch is no syllable."""
    i = _index(ch)
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    return F.when(i.isNotNull(), F.struct(pick(INITIALS, F.floor(i / 588)).alias("initial"), pick(MEDIALS, F.floor(F.pmod(i, F.lit(588)) / 28)).alias("medial"), pick(FINALS, F.pmod(i, F.lit(28))).alias("final")))


def initial_of(ch: Column) -> Column:
    """The initial of a syllable; any other character as it is."""
    i = _index(ch)
    return F.when(i.isNull(), ch).otherwise(F.element_at(F.array(*map(F.lit, INITIALS)), (F.floor(i / 588) + 1).cast("int")))


def initials(text: Column) -> Column:
    """text with every syllable as its initial."""
    return F.array_join(F.transform(F.split(text, ""), initial_of), "")


def is_initials_query(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "").rlike(f"^[{INITIALS}]+$")


def search_pattern(query: str) -> str:
    """A regular expression for an initials-or-syllables query, made on the driver.

    A lone initial matches any syllable with it; the last syllable may be one that
    is still being typed: without a final it takes any final, and a final may
    turn out to be the next syllable's initial.
    """
    import re
    import unicodedata

    q = re.sub(r"\s", "", unicodedata.normalize("NFC", query)).lower()
    out = []
    for n, c in enumerate(q):
        code = ord(c)
        if c in INITIALS:
            a = FIRST + INITIALS.index(c) * 588
            out.append(f"[{c}{chr(a)}-{chr(a + 587)}]")
        elif FIRST <= code <= LAST and n == len(q) - 1:
            k = (code - FIRST) % 28
            if k == 0:
                out.append(f"[{c}-{chr(code + 27)}]")
            elif FINALS[k] in INITIALS:
                a = FIRST + INITIALS.index(FINALS[k]) * 588
                out.append(f"(?:{c}|{chr(code - k)}[{chr(a)}-{chr(a + 587)}])")
            else:
                out.append(c)
        else:
            out.append(re.escape(c))
    return "".join(out)


def search_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, SPACE, ""))


@F.pandas_udf(StringType())
def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFC: Spark has no function for it."""
    import unicodedata

    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


#: Conjoining jamo and combining marks: a text without one is composed already.
LOOSE = r"[\x{300}-\x{36F}\x{1100}-\x{11FF}]"


def is_composed(text: Column) -> Column:
    return ~F.coalesce(text.rlike(LOOSE), F.lit(False))


#: A syllable in conjoining jamo.
SYLLABLE = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?"


def composed(text: Column) -> Column:
    """text with its syllables composed, as NFC has them. A text without loose jamo costs one look."""
    from ..operators.positions import let, matches, rebuild

    def syllable(hit):
        code = lambda i: F.ascii(F.substring(hit, i, 1))
        last = F.when(F.length(hit) > 2, code(3) - 0x11A7).otherwise(0)
        return let(FIRST + ((code(1) - 0x1100) * 21 + code(2) - 0x1161) * 28 + last, _character)

    change = lambda m: F.struct(m["start"].alias("start"), F.length(m["hit"]).alias("len"), syllable(m["hit"]).alias("new"))
    return F.when(text.rlike(SYLLABLE), rebuild(text, F.transform(matches(text, SYLLABLE), change))).otherwise(text)


def _character(code: Column) -> Column:
    """The character of a code point of three bytes in UTF-8."""
    byte = lambda head, shift: F.hex((F.lit(head) + F.shiftright(code, shift).bitwiseAND(F.lit(63 if head == 128 else 15))).cast("long"))
    return F.decode(F.unhex(F.concat(byte(224, 12), byte(128, 6), byte(128, 0))), "UTF-8")


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


FULLWIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def normalize_width(text: Column) -> Column:
    """Full-width ASCII to ASCII, invisible spaces to a space, zero-width characters away."""
    out = F.translate(text, FULLWIDTH, ASCII)
    out = F.regexp_replace(out, r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]", " ")
    return F.regexp_replace(out, r"[\x{200B}-\x{200D}\x{FEFF}\x{2060}]", "")


def clean_field(text: Column) -> Column:
    """normalize_width with runs of white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(normalize_width(F.coalesce(text, F.lit(""))), SPACE + "+", " "))


def check_digit_count(value: Column, n: int) -> Column:
    """struct(ok, reason): exponent, short or long; reason is '' where ok."""
    text = F.trim(normalize_width(F.coalesce(value, F.lit(""))))
    have = F.length(F.regexp_replace(text, "[^0-9]", ""))
    reason = F.when(text.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?[eE][+-]?[0-9]+$"), "exponent").when(have == n, "").when(have < n, "short").otherwise("long")
    return F.struct((reason == "").alias("ok"), reason.alias("reason"))


def korean_sort_key(text: Column) -> Column:
    """Orders Hangul before Latin, and digit runs by their number, however long: each is led by how many digits it has."""
    text = composed(text)
    digits = F.regexp_extract_all(text, F.lit("[0-9]+"), 0)
    pieces = F.split(text, "[0-9]+", -1)

    def counted(d):
        plain = F.when(d.rlike("^0+$"), "0").otherwise(F.ltrim(d, F.lit("0")))
        return F.concat(F.lpad(F.length(plain).cast("string"), 10, "0"), plain)

    joined = F.array_join(F.flatten(F.zip_with(pieces, F.transform(digits, counted), lambda p, d: F.array(p, F.coalesce(d, F.lit(""))))), "")
    return F.concat(F.when(F.substring(text, 1, 1).rlike("[가-힣ㄱ-ㅣ]"), "1").when(F.substring(text, 1, 1).rlike("[0-9]"), "0").otherwise("2"), F.lower(joined))
