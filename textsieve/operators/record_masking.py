"""Masking of records by a walk over the schema: the result is one expression tree that Catalyst sees whole."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NumericType, StringType, StructType

from ..functions import formats
from .identifiers import GLUED, SEPARATED, birth_date
from .positions import matches, merge_spans, overwrite, spans

# Field names by masker, lower case, without _ - and spaces.
MASKERS = {
    formats.mask_name: ["name", "username", "membername", "fullname", "이름", "성명"],
    formats.mask_resident_number: ["residentnumber", "residentregistrationnumber", "rrn", "jumin", "juminnumber", "juminregistrationnumber", "주민등록번호", "주민번호"],
    formats.mask_phone: ["phone", "phones", "phonenumber", "mobile", "mobilenumber", "tel", "telephone", "cellphone", "휴대폰", "휴대폰번호", "휴대전화", "전화", "전화번호"],
    formats.mask_email: ["email", "emails", "mail", "이메일", "전자우편"],
    formats.mask_account: ["account", "accounts", "accountnumber", "cardnumber", "card", "cards", "계좌", "계좌번호", "카드번호"],
    formats.mask_address: ["address", "주소"],
}
BY_KEY = {key: masker for masker, keys in MASKERS.items() for key in keys}
TOGETHER = {"birthdate", "birthday", "zipcode"}
MAX_DEPTH = 6
PHONE = r"(?<![0-9])(?:01[016789][-.\s]?[0-9]{3,4}[-.\s]?[0-9]{4}|0(?:2|[3-6][1-4])[-.\s]?[0-9]{3,4}[-.\s]?[0-9]{4})(?![0-9])"


def key_of(name: str) -> str:
    return re.sub(r"[_\-\s]", "", name.lower())


def mask_free_text(text: Column) -> Column:
    """Resident numbers and phones starred in place."""
    plausible = lambda c: F.filter(c, lambda m: birth_date(m["hit"]).isNotNull())
    found = merge_spans(F.concat(spans(plausible(matches(text, SEPARATED))), spans(plausible(matches(text, GLUED))), spans(matches(text, PHONE))))
    return overwrite(text, found, "*")


def mask_free_number(value: Column) -> Column:
    text = value.cast("string")
    hit = (text.rlike("^[0-9]{6}[1-8][0-9]{6}$") & birth_date(text).isNotNull()) | text.rlike("^(?:0?1[016789][0-9]{7,8}|0?2[0-9]{7,8}|0?[3-6][1-4][0-9]{6,7})$")
    return F.when(hit, F.repeat(F.lit("*"), F.length(text))).otherwise(text)


def _leaf(t: DataType) -> bool:
    return not isinstance(t, (StructType, ArrayType))


def masked(value: Column, kind: DataType, name: str, depth: int = 1) -> Column:
    masker = BY_KEY.get(key_of(name))
    if not _leaf(kind):
        inner = kind.elementType if isinstance(kind, ArrayType) else None
        if depth > MAX_DEPTH or (masker and not (inner is not None and _leaf(inner))):
            return F.when(value.isNotNull(), "****")
        if inner is not None:
            return F.transform(value, lambda x: masked(x, inner, name, depth + 1))
        return F.when(value.isNotNull(), F.struct(*[masked(value[f.name], f.dataType, f.name, depth + 1).alias(f.name) for f in kind]))
    if masker:
        text = value.cast("string")
        return F.when(text.isNotNull(), masker(text))
    if isinstance(kind, StringType):
        return mask_free_text(value)
    return mask_free_number(value) if isinstance(kind, NumericType) else value


def mask_records(df: DataFrame) -> DataFrame:
    """df with every column masked by its name and kind."""
    return df.select(*[masked(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema])


def combination_warning(df: DataFrame) -> list[str]:
    """Identifying fields that mask_records shows, where there are two or more."""
    shown = [f.name for f in df.schema if key_of(f.name) in TOGETHER]
    return shown if len(shown) > 1 else []
