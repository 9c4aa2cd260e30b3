"""Numbers, phones and addresses of Korea as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hangul import normalize_width

# Weights of the check digits.
BUSINESS_WEIGHTS = [1, 3, 7, 1, 3, 7, 1, 3, 5]
CORPORATE_WEIGHTS = [1, 2] * 6
# Telephone prefixes.
MOBILE = ["010", "011", "016", "017", "018", "019"]
SPECIAL = ["060", "070", "080", "0502", "0503", "0504", "0505", "0506", "0507"]
SAFE = ["0503", "0504", "0506", "0507"]
AREAS = ["031", "032", "033", "041", "042", "043", "044", "051", "052", "053", "054", "055", "061", "062", "063", "064", "02"]
# Names of the regions, the short one first.
REGIONS = {
    "서울": ["서울특별시", "서울시"], "부산": ["부산광역시", "부산시"], "대구": ["대구광역시", "대구시"], "인천": ["인천광역시", "인천시"], "광주": ["광주광역시"],
    "대전": ["대전광역시", "대전시"], "울산": ["울산광역시", "울산시"], "세종": ["세종특별자치시", "세종시"], "경기": ["경기도"], "강원": ["강원특별자치도", "강원도"],
    "충북": ["충청북도"], "충남": ["충청남도"], "전북": ["전북특별자치도", "전라북도"], "전남": ["전라남도"], "경북": ["경상북도"], "경남": ["경상남도"], "제주": ["제주특별자치도", "제주도"],
}
CANONICAL = {name: short for short, names in REGIONS.items() for name in [short, *names]}
ROAD = r"^(.*?[가-힣]+(?:로[0-9]+길|[로길])\s*(?:지하\s*)?[0-9]+(?:-[0-9]+)?)(?![0-9가호동층길-])"
LOT = r"^(.*?[가-힣]+(?:[0-9]+가|[동리가])\s*(?:산\s*)?[0-9]+(?:-[0-9]+)?)(?![0-9호동층-])"
POSTAL = r"^(?:0[1-9]|[1-5][0-9]|6[0-3])[0-9]{3}$"


def digits(value: Column) -> Column:
    return F.regexp_replace(normalize_width(F.coalesce(value, F.lit(""))), "[^0-9]", "")


def _checked(value: Column, weights: list[int], extra=None) -> Column:
    d = digits(value)
    n = len(weights) + 1
    at = lambda i: F.substring(d, i + 1, 1).try_cast("int")
    total = sum((at(i) * w for i, w in enumerate(weights)), F.lit(0))
    if extra is not None:
        total = total + extra(at)
    return F.coalesce((F.length(d) == n) & (F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)) == at(n - 1)), F.lit(False))


def valid_business_number(value: Column) -> Column:
    return _checked(value, BUSINESS_WEIGHTS, lambda at: F.floor(at(8) * 5 / 10))


def valid_corporate_number(value: Column) -> Column:
    return _checked(value, CORPORATE_WEIGHTS)


def format_business_number(value: Column) -> Column:
    d = digits(value)
    return F.when(F.length(d) == 10, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 5))).otherwise(value)


def domestic_digits(value: Column) -> Column:
    d = digits(value)
    d = F.when(d.startswith("0082"), F.substring(d, 3, 99)).otherwise(d)
    rest = F.substring(d, 3, 99)
    return F.when(d.startswith("82"), F.when(rest.startswith("0"), rest).otherwise(F.concat(F.lit("0"), rest))).otherwise(d)


def parse_phone(value: Column) -> Column:
    """struct(kind, head, middle, tail); null for no phone. A known prefix with a wrong length ends it."""
    d = domestic_digits(value)
    starts = lambda ps: d.rlike("^(?:" + "|".join(ps) + ")")

    def parts(kind, size):
        rest = F.length(d) - size
        cut = F.struct(kind.alias("kind"), F.substring(d, 1, size).alias("head"), F.substring(d, F.lit(size + 1), rest - 4).alias("middle"), F.right(d, F.lit(4)).alias("tail"))
        return F.when(rest.isin(7, 8), cut)

    special4 = [p for p in SPECIAL if len(p) == 4]
    shared = F.struct(F.lit("shared").alias("kind"), F.substring(d, 1, 4).alias("head"), F.lit("").alias("middle"), F.substring(d, 5, 4).alias("tail"))
    kind = F.when(starts(SAFE), "safe").otherwise("special")
    return (
        F.when(starts(MOBILE), parts(F.lit("mobile"), 3))
        .when(d.rlike("^1[568][0-9]{6}$"), shared)
        .when(starts(special4), parts(kind, 4))
        .when(starts([p for p in SPECIAL if len(p) == 3]), parts(kind, 3))
        .when(starts(["02"]), parts(F.lit("area"), 2))
        .when(starts([a for a in AREAS if a != "02"]), parts(F.lit("area"), 3))
    )


def format_phone(value: Column) -> Column:
    p = parse_phone(value)
    return F.when(p.isNull(), value).otherwise(F.array_join(F.filter(F.array(p["head"], p["middle"], p["tail"]), lambda x: x != ""), "-"))


def international(value: Column) -> Column:
    p = parse_phone(value)
    return F.when(p.isNotNull(), F.concat(F.lit("+82"), F.regexp_replace(F.concat(p["head"], p["middle"], p["tail"]), "^0", "")))


def is_safe_number(value: Column) -> Column:
    return domestic_digits(value).rlike("^(?:" + "|".join(SAFE) + ")")


def valid_postal_code(value: Column) -> Column:
    return F.trim(normalize_width(value)).rlike(POSTAL)


def address_kind(address: Column) -> Column:
    text = F.trim(address)
    road = text.rlike(r"[로길]\s*(?:지하\s*)?[0-9]+(?:-[0-9]+)?(?![0-9가-])")
    lot = text.rlike(r"[동리가]\s*(?:산\s*)?[0-9]+(?:-[0-9]+)?(?![0-9-])")
    return F.when(road, "road").when(lot, "lot").otherwise("unknown")


def split_reference(address: Column) -> Column:
    """struct(base, reference): the balanced parenthesis at the end, taken off."""
    text = F.trim(address)
    chars = F.reverse(F.split(text, ""))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("found"))

    def step(acc, c):
        depth = acc["depth"] + F.when(c == ")", 1).when(c == "(", -1).otherwise(0)
        n = acc["n"] + 1
        return F.when(acc["found"] > 0, acc).otherwise(F.struct(depth.alias("depth"), n.alias("n"), F.when((c == "(") & (depth == 0), n).otherwise(0).alias("found")))

    found = F.when(text.endswith(")"), F.aggregate(chars, zero, step)["found"]).otherwise(0)
    base = F.trim(F.substring(text, F.lit(1), F.length(text) - found))
    return F.when(found > 0, F.struct(base.alias("base"), F.trim(F.substring(text, F.length(text) - found + 2, found - 2)).alias("reference"))).otherwise(F.struct(text.alias("base"), F.lit("").alias("reference")))


def address_key(address: Column) -> Column:
    """Equal for two ways to write one address: region by its short name, no space but between numbers."""
    base = F.regexp_replace(split_reference(address)["base"], r"\s+", " ")
    first = F.regexp_extract(base, r"^(\S*)", 1)
    name = F.regexp_extract(first, "^(" + "|".join(sorted(CANONICAL, key=lambda n: (-len(n), n))) + ")", 1)
    short = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CANONICAL.items() for x in kv]), name), F.lit(""))
    joined = F.when(name == "", base).otherwise(F.concat(short, F.lit(" "), F.right(base, F.length(base) - F.length(name))))
    return F.regexp_replace(joined, r"(?<![0-9])\s+|\s+(?![0-9])", "")


def mask_name(name: Column) -> Column:
    n = F.length(name)
    return F.when(n == 0, "").when(n == 1, "*").when(n == 2, F.concat(F.substring(name, 1, 1), F.lit("*"))).otherwise(F.concat(F.substring(name, 1, 1), F.repeat(F.lit("*"), n - 2), F.right(name, F.lit(1))))


def mask_resident_number(value: Column) -> Column:
    d = digits(value)
    return F.when(F.length(d) == 13, F.concat(F.substring(d, 1, 6), F.lit("-*******"))).otherwise(F.repeat(F.lit("*"), F.length(value)))


def mask_phone(value: Column) -> Column:
    d = digits(value)
    head = F.when(d.startswith("02"), F.substring(d, 1, 2)).otherwise(F.substring(d, 1, 3))
    return F.when(F.length(d) < 9, F.repeat(F.lit("*"), F.length(value))).otherwise(F.concat(head, F.lit("-****-"), F.right(d, F.lit(4))))


def mask_email(value: Column) -> Column:
    at = F.length(value) - F.length(F.substring_index(value, "@", -1))  # with the last @
    local, domain = F.substring(value, F.lit(1), at - 1), F.right(value, F.length(value) - at + 1)
    keep = F.when(at - 1 <= 2, 0).otherwise(2)
    masked = F.concat(F.substring(local, F.lit(1), keep), F.repeat(F.lit("*"), at - 1 - keep), domain)
    return F.when(at <= 1, F.repeat(F.lit("*"), F.length(value))).otherwise(masked)


def mask_account(value: Column) -> Column:
    d = digits(value)
    n = F.length(d)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(d, F.lit(4))))


def mask_address(value: Column) -> Column:
    """Up to the house number; else province and districts; else all stars."""
    text = F.trim(value)
    road, lot = F.regexp_extract(text, ROAD, 1), F.regexp_extract(text, LOT, 1)
    names = "|".join(sorted(CANONICAL, key=lambda n: (-len(n), n)))
    region = F.regexp_extract(text, rf"^({names})", 1)
    whole = F.regexp_extract(text, rf"^((?:{names})(?:\s+[^0-9\s]*[시군구](?=\s|$))*)(?=\s|$)", 1)
    place = F.regexp_replace(F.when(whole != "", whole).otherwise(region), r"\s+", " ")
    rest = lambda p: F.when(F.trim(F.right(text, F.length(text) - F.length(p))) == "", p).otherwise(F.concat(p, F.lit(" ****")))
    return F.when(road != "", rest(road)).when(lot != "", rest(lot)).when(place == "", "****").when(place == text, place).otherwise(F.concat(place, F.lit(" ****")))
