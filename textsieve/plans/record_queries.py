"""Queries over identifiers, addresses, calendars, links, reviews and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formats, hangul, workdays
from ..operators import guard, identifiers, record_masking, review, rules, shell, stats, tone
from . import record_sql
from .derived import ADDRESS_SQL, BIZ_SQL, NAME_SQL, PHONE_SQL, RRN_SQL, count, ko_docs, long, table, view

CENTURY = "CASE WHEN substr(back, 1, 1) IN ('1','2','5','6') THEN '19' ELSE '20' END"
BIRTH = f"try_strptime({CENTURY} || front, '%Y%m%d')"
# Places of 13 digits in a row or in two runs, with what stands around them: no look-around in DuckDB.
RRN_HITS = f"""d AS ({RRN_SQL}), c AS (SELECT d.*, q, regexp_extract(substr(text, q, 17), '^[0-9]{{6}}( ?- ?| {{1,2}})?[1-8][0-9]{{6}}') AS hit,
  CASE WHEN q > 1 THEN substr(text, q - 1, 1) ELSE '' END AS prev FROM d, range(1, 40) t(q) WHERE q <= length(text)),
h AS (SELECT *, length(hit) = 13 AS glued, substr(text, q + length(hit), 1) AS next, substr(text, 1, q - 1) AS before FROM c WHERE hit <> ''),
r AS (SELECT * FROM h WHERE NOT regexp_matches(next, '^[0-9A-Za-z_]') AND CASE WHEN glued THEN NOT regexp_matches(prev, '^[0-9A-Za-z_.]') AND NOT regexp_matches(before, 'created_at: $') ELSE NOT regexp_matches(prev, '^[0-9]') END
  AND {BIRTH} IS NOT NULL)"""


def rrn(spark, d):
    return view(spark, d, RRN_SQL)


def rrn_detect(spark, d):
    return identifiers.resident_numbers(rrn(spark, d), "id").select("id", "line", "col", "len", "matched")


def rrn_redact(spark, d):
    return identifiers.redact(rrn(spark, d), "id").select("id", "text")


def rrn_birth_year(spark, d):
    born = identifiers.birth_date(F.concat("front", "back"))
    return rrn(spark, d).select("id", long(F.year(born)).alias("year"))


def glued_time_key_exempt(spark, d):
    lines = rrn(spark, d).where(F.col("text").rlike("[0-9]{13}"))
    prefix = F.regexp_extract("text", "^(.*?)[0-9]{6}", 1)
    return lines.select("id", identifiers.time_key_before(prefix).alias("exempt"))


SPANS = "SELECT o_orderkey // 4 AS g, o_orderkey % 7 * 3 AS s, o_orderkey % 7 * 3 + 2 + o_orderkey % 5 AS e FROM orders"


def merge_spans(spark, d):
    """Islands by a running maximum; ranges that touch stay apart."""
    o = table(spark, d, "orders").selectExpr("cast(o_orderkey div 4 AS bigint) AS g", "o_orderkey % 7 * 3 AS s", "o_orderkey % 7 * 3 + 2 + o_orderkey % 5 AS e")
    w = Window.partitionBy("g").orderBy("s", F.desc("e"))
    new = F.coalesce(F.col("s") >= F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return o.withColumn("new", new.cast("int")).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("g", "k").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("g", "s", "e")


def names(spark, d):
    return view(spark, d, NAME_SQL)


def mask_people(spark, d):
    return names(spark, d).select("id", formats.mask_name(F.col("name")).alias("name"), formats.mask_email(F.col("email")).alias("email"), formats.mask_account(F.col("account")).alias("account"))


def mask_phone(spark, d):
    return view(spark, d, PHONE_SQL).select("id", formats.mask_phone(F.col("value")).alias("masked"))


def mask_address(spark, d):
    return view(spark, d, ADDRESS_SQL).select("id", formats.mask_address(F.col("value")).alias("masked"))


def mask_record_struct(spark, d):
    people = names(spark, d).select("id", F.struct(F.col("name").alias("user_name"), F.struct("email", F.array("account").alias("accounts")).alias("contact")).alias("person"))
    out = record_masking.mask_records(people)
    return out.select(F.col("id").try_cast("bigint").alias("id"), F.col("person.user_name").alias("name"), F.col("person.contact.email").alias("email"), F.col("person.contact.accounts")[0].alias("account"))


MASK_SQL = f"""WITH n AS ({NAME_SQL}), a AS (SELECT *, regexp_replace(account, '[^0-9]', '', 'g') AS dg, length(email) - length(string_split(email, '@')[-1]) - 1 AS loc FROM n)
SELECT id, CASE WHEN length(name) = 0 THEN '' WHEN length(name) = 1 THEN '*' WHEN length(name) = 2 THEN substr(name, 1, 1) || '*' ELSE substr(name, 1, 1) || repeat('*', length(name) - 2) || right(name, 1) END AS name,
CASE WHEN loc <= 0 THEN repeat('*', length(email)) WHEN loc <= 2 THEN repeat('*', loc) || substr(email, loc + 1) ELSE substr(email, 1, 2) || repeat('*', loc - 2) || substr(email, loc + 1) END AS email,
CASE WHEN length(dg) <= 4 THEN repeat('*', length(dg)) ELSE repeat('*', length(dg) - 4) || right(dg, 4) END AS account FROM a"""
PHONES = f"""WITH p AS ({PHONE_SQL}), d AS (SELECT id, value, regexp_replace(value, '[^0-9]', '', 'g') AS a FROM p), e AS (SELECT id, value, a, CASE WHEN starts_with(a, '0082') THEN substr(a, 3) ELSE a END AS b FROM d),
g AS (SELECT id, value, a, CASE WHEN starts_with(b, '82') THEN CASE WHEN starts_with(substr(b, 3), '0') THEN substr(b, 3) ELSE '0' || substr(b, 3) END ELSE b END AS x FROM e),
k AS (SELECT *, CASE WHEN regexp_matches(x, '^01[016789]') THEN 'mobile' WHEN regexp_matches(x, '^1[568][0-9]{{6}}$') THEN 'shared' WHEN regexp_matches(x, '^050[3467]') THEN 'safe' WHEN regexp_matches(x, '^(060|070|080|050[25])') THEN 'special'
  WHEN starts_with(x, '02') THEN 'area' WHEN regexp_matches(x, '^0(3[1-3]|4[1-4]|5[1-5]|6[1-4])') THEN 'area' END AS k,
  CASE WHEN regexp_matches(x, '^050[2-7]') THEN 4 WHEN starts_with(x, '02') THEN 2 ELSE 3 END AS n FROM g),
r AS (SELECT *, k = 'shared' OR (k IS NOT NULL AND length(x) - n IN (7, 8)) AS ok0 FROM k), r2 AS (SELECT *, coalesce(ok0, false) AS ok FROM r)"""


def phone_kinds(spark, d):
    p = view(spark, d, PHONE_SQL).withColumn("p", formats.parse_phone(F.col("value")))
    return p.select("id", F.coalesce("p.kind", F.lit("none")).alias("kind"), formats.format_phone(F.col("value")).alias("formatted"))


def phone_international(spark, d):
    return view(spark, d, PHONE_SQL).select("id", F.coalesce(formats.international(F.col("value")), F.lit("")).alias("number"))


def biz_number_valid(spark, d):
    b = view(spark, d, BIZ_SQL)
    return b.select("id", formats.valid_business_number(F.col("value")).alias("business"), formats.valid_corporate_number(F.col("corp")).alias("corporate"), formats.format_business_number(F.col("value")).alias("formatted"))


def _check_sql(col, weights, extra="0"):
    n = len(weights)
    total = " + ".join(f"cast(substr({col}, {i + 1}, 1) AS int) * {w}" for i, w in enumerate(weights))
    return f"(10 - ({total} + {extra}) % 10) % 10 = cast(substr({col}, {n + 1}, 1) AS int)"


BIZ = f"WITH b AS ({BIZ_SQL}) SELECT id, length(value) = 10 AND {_check_sql('value', formats.BUSINESS_WEIGHTS, 'cast(substr(value, 9, 1) AS int) * 5 // 10')} AS business, length(corp) = 13 AND {_check_sql('corp', formats.CORPORATE_WEIGHTS)} AS corporate, substr(value, 1, 3) || '-' || substr(value, 4, 2) || '-' || substr(value, 6) AS formatted FROM b"


def address_kind(spark, d):
    return view(spark, d, ADDRESS_SQL).select("id", formats.address_kind(F.col("value")).alias("kind"))


def address_same(spark, d):
    """Groups of addresses with one key: an aggregate, not a self-join."""
    a = view(spark, d, ADDRESS_SQL).withColumn("k", formats.address_key(F.col("value")))
    return a.groupBy("k").agg(F.min("id").alias("first_id"), count("n"))


def sort_korean_topn(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    named = p.withColumn("name", F.concat(F.when(F.col("p_partkey") % 3 == 0, "나").otherwise("item"), F.col("p_partkey").cast("string")))
    return named.orderBy(hangul.korean_sort_key(F.col("name")), "p_partkey").limit(50).select("p_partkey", "name")


CELL = "CASE c_custkey % 6 WHEN 0 THEN '０１２３４５６７８９' WHEN 1 THEN '=1+2' WHEN 2 THEN '1.2E+9' WHEN 3 THEN 'a,\"b\"' WHEN 4 THEN '  ＡＢＣ　가  나 ' ELSE '-7' END"


def width_clean(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey AS id", f"{CELL} AS cell")
    check = hangul.check_digit_count(F.col("cell"), 10)
    return c.select("id", hangul.clean_field(F.col("cell")).alias("clean"), check["ok"].alias("ok"), check["reason"].alias("reason"), review.escape_cell(F.col("cell")).alias("escaped"))


CELL_SQL = f"""WITH c AS (SELECT c_custkey AS id, {CELL} AS cell FROM customer), n AS (SELECT id, cell, trim(regexp_replace(regexp_replace(translate(cell, '{hangul.FULLWIDTH.replace("'", "''")}', '{hangul.ASCII.replace("'", "''")}'), '　', ' ', 'g'), ' +', ' ', 'g')) AS clean FROM c),
d AS (SELECT *, length(regexp_replace(clean, '[^0-9]', '', 'g')) AS k, CASE WHEN regexp_matches(cell, '^[=+@-]') THEN '''' || cell ELSE cell END AS safe FROM n),
r AS (SELECT *, CASE WHEN regexp_matches(clean, '^[+-]?[0-9]+([.][0-9]+)?[eE][+-]?[0-9]+$') THEN 'exponent' WHEN k = 10 THEN '' WHEN k < 10 THEN 'short' ELSE 'long' END AS reason FROM d)
SELECT id, clean, reason = '' AS ok, reason, CASE WHEN regexp_matches(safe, '[",]') THEN '"' || replace(safe, '"', '""') || '"' ELSE safe END AS escaped FROM r"""

# Invented calendar with the branches that matter: a Sunday, a Saturday, two on one day.
HOLIDAYS = [("2024-01-01", "신정"), ("2024-02-09", "설날 연휴"), ("2024-02-10", "설날"), ("2024-02-11", "설날"), ("2024-03-01", "삼일절"), ("2024-05-05", "어린이날"), ("2024-05-15", "부처님오신날"), ("2024-06-06", "현충일"), ("2024-08-15", "광복절"), ("2024-09-17", "추석"), ("2024-10-03", "개천절"), ("2024-10-09", "한글날"), ("2024-12-25", "성탄절"), ("2025-05-05", "어린이날"), ("2025-05-05", "부처님오신날"), ("2025-03-01", "3·1절")]
CLOSED = sorted({d for d, _ in HOLIDAYS})
CLOSED_SQL = "(VALUES " + ", ".join(f"(date '{d}')" for d in CLOSED) + ") AS c(d)"


def _closed(spark):
    return spark.createDataFrame([(d,) for d in CLOSED], "d string").select(F.to_date("d").alias("d"))


def business_days_add(spark, d):
    days = workdays.calendar(_closed(spark), "2023-12-01", "2025-12-31")
    e = table(spark, d, "events").select("event_id", (F.make_date(F.lit(2024), F.lit(1), F.lit(1)) + (F.col("event_id") % 300).cast("int")).alias("day"), (F.col("event_id") % 12).alias("n"))
    return workdays.add_business_days(e, "day", F.col("n"), days).select("event_id", F.date_format("due", "yyyy-MM-dd").alias("due"))


def bank_closed(spark, d):
    return workdays.bank_closed(_closed(spark), 2023, 2027).select(F.date_format("d", "yyyy-MM-dd").alias("d"))


def kst_daily_events(spark, d):
    e = table(spark, d, "events").select(F.to_date(F.col("ts").cast("timestamp_ntz") + F.expr("INTERVAL 9 HOURS")).alias("day"))
    return e.groupBy("day").agg(count("n")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def substitute_holidays(spark, d):
    return spark.createDataFrame(workdays.with_substitutes(HOLIDAYS), "date string, name string, substitute_for string")


def links_extract(spark, d):
    pages = table(spark, d, "pages").selectExpr("page_id", f"'see ' || {URL_COL} || ' and' || chr(10) || {URL_COL} AS body")
    return review.extract_links(pages, "page_id", "body").select("page_id", "line", "url")


URL_COL = "url || CASE page_id % 5 WHEN 0 THEN ').' WHEN 1 THEN '.' WHEN 2 THEN '(a)' WHEN 3 THEN '!?' ELSE '' END"

TRIMMED = "url || CASE WHEN page_id % 5 = 2 THEN '(a)' ELSE '' END"


def links_trimmed(spark, d):
    p = table(spark, d, "pages").selectExpr("page_id", f"{URL_COL} AS u")
    return p.select("page_id", review.trim_url(F.col("u")).alias("url"), F.coalesce(F.try_parse_url("u", F.lit("HOST")), F.lit("")).alias("host"))


def links_grouped(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 7).alias("file"), F.col("page_id").alias("line"), F.regexp_extract("url", r"^https?://[^/]+", 0).alias("url"))
    out = review.group_links(p, "file")
    return out.select("url", "n", F.array_join(F.transform("locations", lambda x: F.concat_ws(":", x["file"], x["line"])), ",").alias("locations"))


PROBE = "page_id AS id, CASE page_id % 9 WHEN 0 THEN 6 WHEN 1 THEN 28 WHEN 2 THEN 35 ELSE 0 END AS curl_exit, CASE page_id % 8 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN NULL ELSE 200 END AS http_code, CASE page_id % 11 WHEN 0 THEN '오류 페이지' WHEN 1 THEN 'Not Found' WHEN 2 THEN NULL ELSE 'home' END AS title"


def links_status(spark, d):
    p = table(spark, d, "pages").selectExpr(*PROBE.replace("END AS http", "END AS http").split(", "))
    return p.select("id", review.link_status(F.col("http_code"), F.col("curl_exit"), F.col("title")).alias("status"))


def fingerprints(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", review.fingerprint(F.col("role"), F.lit(None), F.lit("bad"), F.col("text")).alias("fp"))


CURRENT = "conv_id % 3 <> 0"


def _threads(spark, d):
    c = table(spark, d, "conversations")
    t = c.select(F.col("conv_id").alias("thread_id"), F.sha1(F.encode("text", "UTF-8")).alias("fp"), (F.col("conv_id") % 5 == 0).alias("is_resolved"), (F.col("conv_id") % 7 == 0).alias("is_outdated"), (F.col("conv_id") % 2 == 0).alias("ours"), (F.col("conv_id") % 11 == 0).alias("human_reply"))
    return t, c.where(CURRENT).select(F.sha1(F.encode("text", "UTF-8")).alias("fp"), "conv_id", "turn")


def review_to_post(spark, d):
    threads, found = _threads(spark, d)
    return review.plan_review(found, threads)[0].select("conv_id", "turn", "fp")


def review_to_resolve(spark, d):
    threads, found = _threads(spark, d)
    return review.plan_review(found, threads)[1]


THREADS = "t AS (SELECT conv_id AS thread_id, sha1(text) AS fp, conv_id % 5 = 0 AS res, conv_id % 7 = 0 AS old, conv_id % 2 = 0 AS ours, conv_id % 11 = 0 AS human FROM conversations), f AS (SELECT conv_id, turn, sha1(text) AS fp FROM conversations WHERE conv_id % 3 <> 0)"
PATCH = "'@@ -1,3 +' || cast(1 + page_id % 9 AS varchar(9)) || ',4 @@ top' || chr(10) || ' same' || chr(10) || '-old' || chr(10) || '+new ' || cast(page_id AS varchar(9)) || chr(10) || ' tail' || chr(10) || '@@ -20 +' || cast(30 + page_id % 5 AS varchar(9)) || ' @@' || chr(10) || '+added'"


def diff_commentable_lines(spark, d):
    p = table(spark, d, "pages").selectExpr("page_id", f"{PATCH} AS patch")
    return review.commentable_lines(p, "page_id").select("page_id", "line", "text")


def comments_in_out_diff(spark, d):
    p = table(spark, d, "pages").selectExpr("page_id AS filename", f"{PATCH} AS patch")
    lines = review.commentable_lines(p)
    found = table(spark, d, "pages").select(F.col("page_id").alias("filename"), (F.col("page_id") % 40 + 1).alias("line"), F.lit("m").alias("message"))
    inside, outside = review.comments(found, lines)
    return inside.select("filename", "line", F.lit(True).alias("inside")).unionByName(outside.select("filename", "line", F.lit(False).alias("inside")))


DIFF = f"""WITH r AS (SELECT page_id, unnest(string_split({PATCH}, chr(10))) AS row, generate_subscripts(string_split({PATCH}, chr(10)), 1) AS n FROM pages), h AS (SELECT *, CASE WHEN starts_with(row, '@@') THEN n END AS hn, CASE WHEN starts_with(row, '@@') THEN cast(regexp_extract(row, '[+]([0-9]+)', 1) AS int) END AS h FROM r),
g AS (SELECT *, max(hn) OVER w AS hunk, last_value(h IGNORE NULLS) OVER w AS first FROM h WINDOW w AS (PARTITION BY page_id ORDER BY n)),
l AS (SELECT page_id, n, row, regexp_matches(row, '^[ +]') AS shown, first + sum(CASE WHEN regexp_matches(row, '^[ +]') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, hunk ORDER BY n) - 1 AS line FROM g),
s AS (SELECT page_id, cast(line AS bigint) AS line, substr(row, 2) AS text FROM l WHERE shown)"""


def _sides(spark):
    base = rules.rules_frame(spark)
    head = [r for i, r in enumerate(rules.RULES) if i != 2] + [("", "새말", "새 말", "", "치환", "보통", None, "base")]
    head[0] = (*head[0][:2], "되어요", *head[0][3:5], "참고", *head[0][6:])
    return base, rules.rules_frame(spark, head), head


def rule_diff(spark, d):
    base, head, _ = _sides(spark)
    return rules.diff_rules(base, head)


_q = lambda s: "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"
_HEAD = [r for i, r in enumerate(rules.RULES) if i != 2] + [("", "새말", "새 말", "", "치환", "보통", None, "base")]
_HEAD[0] = (*_HEAD[0][:2], "되어요", *_HEAD[0][3:5], "참고", *_HEAD[0][6:])
_values = lambda rs: "(VALUES " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rs) + ') AS r(en, bad, good, why, "check", priority, kind, source)'
DIFF_RULES = f"""SELECT source, bad, CASE WHEN b IS NULL THEN 'added' WHEN h IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN b IS NULL OR h IS NULL THEN '' ELSE concat_ws(',', {', '.join(f"CASE WHEN b.{c} IS DISTINCT FROM h.{c} THEN '{c}' END" for c in ('en', 'good', 'why', 'check', 'priority', 'kind'))}) END AS columns
FROM (SELECT source, bad, struct_pack(en := en, good := good, why := why, "check" := "check", priority := priority, kind := kind) AS b FROM {_values(rules.RULES)}) x
FULL JOIN (SELECT source, bad, struct_pack(en := en, good := good, why := why, "check" := "check", priority := priority, kind := kind) AS h FROM {_values(_HEAD)}) y USING (source, bad) WHERE b IS DISTINCT FROM h"""


def rule_impact_top10(spark, d):
    base, head, _ = _sides(spark)
    docs = ko_docs(spark, d).select("doc_id", "text")

    def counted(r, name):
        pairs = docs.join(F.broadcast(r.where(F.col("check") != "프롬프트").select("source", "bad")), F.col("text").contains(F.col("bad")))
        n = F.sum((F.length("text") - F.length(F.replace("text", F.col("bad")))) / F.length("bad")).cast("long")
        return pairs.groupBy("source", "bad").agg(n.alias(name))

    both = counted(base, "before").join(counted(head, "after"), ["source", "bad"], "full").fillna(0)
    return both.where("before <> after").orderBy(F.desc(F.abs(F.col("after") - F.col("before"))), "source", "bad").limit(10)


def _samples(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("payload"), (F.col("user_id") % 2).alias("side"), (F.col("event_id") % 10).alias("iter"), F.col("value").alias("ms"))


def latency_summary(spark, d):
    return stats.latency_summary(_samples(spark, d)).select("payload", "side", F.round("median", 6).alias("median"), "p90", "n")


def latency_regression(spark, d):
    s = stats.latency_summary(_samples(spark, d)).groupBy("payload").pivot("side", [0, 1]).agg(F.first("median"))
    return s.select("payload", F.round(F.col("1") - F.col("0"), 6).alias("delta"), stats.is_regression(F.col("0"), F.col("1")).alias("regression"))


BODY_BUDGET = 120
BODY_ROWS = [(r[1], "prompt" if r[4] == "프롬프트" else "terms", r[7], len(r[1]) + len(r[2]) + len(r[3]), r[5]) for r in rules.RULES]


def budgeted_body(spark, d):
    return spark.createDataFrame([(k, n) for n, k in enumerate(review.budgeted(BODY_ROWS, BODY_BUDGET))], "bad string, place long")


def budgeted_sql() -> str:
    """One attempt after the other: a recursion over their numbers."""
    tried = ", ".join(f"({n}, '{key}', '{lane or ''}', '{heading}', {cost})" for n, (key, lane, heading, cost) in enumerate(review.attempts(BODY_ROWS)))
    half = BODY_BUDGET // 2
    return f"""WITH RECURSIVE a AS (SELECT * FROM (VALUES {tried}) AS t(n, bad, lane, heading, cost)),
s AS (SELECT -1 AS n, 0 AS used, 0 AS prompt, 0 AS terms, []::VARCHAR[] AS heads, []::VARCHAR[] AS taken
  UNION ALL SELECT n, CASE WHEN ok THEN used + price ELSE used END, CASE WHEN ok AND lane = 'prompt' THEN prompt + cost ELSE prompt END,
    CASE WHEN ok AND lane = 'terms' THEN terms + cost ELSE terms END, CASE WHEN ok THEN list_append(heads, heading) ELSE heads END, CASE WHEN ok THEN list_append(taken, bad) ELSE taken END
  FROM (SELECT *, NOT list_contains(taken, bad) AND used + price <= {BODY_BUDGET} AND CASE lane WHEN 'prompt' THEN prompt + cost <= {half} WHEN 'terms' THEN terms + cost <= {BODY_BUDGET - half} ELSE true END AS ok
    FROM (SELECT a.n, bad, lane, heading, cost, used, prompt, terms, heads, taken, cost + CASE WHEN list_contains(heads, heading) THEN 0 ELSE length(heading) + 1 END AS price FROM s JOIN a ON a.n = s.n + 1)))
SELECT unnest(taken) AS bad, cast(unnest(range(len(taken))) AS bigint) AS place FROM (SELECT taken FROM s ORDER BY n DESC LIMIT 1)"""


COMMANDS = ["git commit -m 'fix the scan'", 'git add . && git commit -m "one" -m "two \\"quoted\\""', "git commit --message=short", "ls -la; echo git commit", "bash -c 'git commit -m \"inner\"'", "FOO=1 git -C dir commit -am done", "git commit -m \"$(cat <<'EOF'\nbody line\nEOF\n)\"", "git commit -F - <<'EOF'\nfrom a file\nEOF", "git commit -mattached", "(git commit -m group)", "out=$(git commit -m 'in a subshell')", "git commit -m first -- -m path"]


# The messages of each command above, written down by hand: where they stand, and in what quotes.
MESSAGES = [
    [(15, 27, "fix the scan", "'")], [(28, 31, "one", '"'), (37, 51, 'two "quoted"', '"')], [(21, 26, "short", "")], [], [(24, 29, "inner", '"')], [(28, 32, "done", "")],
    [(29, 38, "body line", "heredoc")], [(24, 35, "from a file", "heredoc")], [(13, 21, "attached", "")], [(15, 20, "group", "")], [(21, 34, "in a subshell", "'")], [(14, 19, "first", "")],
]


def commit_targets(spark, d):
    e = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("event_id") % len(COMMANDS) + 1).cast("int")).alias("command"))
    return shell.commit_messages(e, "event_id", "command")


EVENT = """CASE event_id % 6 WHEN 0 THEN '{"tool_name":"Write","hook_event_name":"PreToolUse","tool_input":{"file_path":"a.md","content":"번호 900101-1234567 입니다"}}'
 WHEN 1 THEN '{"tool_name":"Bash","hook_event_name":"PreToolUse","tool_input":{"command":"echo 9001011234567"}}' WHEN 2 THEN '{"tool_name":"Write","hook_event_name":"PostToolUse","tool_input":{"file_path":"b.md","content":"레버리지와 니즈를 살핍니다"}}'
 WHEN 3 THEN 'not json' WHEN 4 THEN '{"tool_name":"Edit","hook_event_name":"PreToolUse","tool_input":{"file_path":"yarn.lock","new_string":"900101-1234567"}}'
 ELSE '{"tool_name":"Write","hook_event_name":"PreToolUse","tool_input":{"file_path":"c.md","content":"created_at: 9001011234567"}}' END"""


def guard_decisions(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", f"{EVENT} AS value")
    return guard.decisions(guard.parsed(e)).select("event_id", long(F.col("n_pii")).alias("n_pii"), long(F.col("n_tone")).alias("n_tone"), F.coalesce("decision", F.lit("none")).alias("decision"))


CALLS = [
    ("Write", "PostToolUse", '"file_path":"a.md","content":"레버리지와 `니즈`를 살핍니다"'),
    ("MultiEdit", "PostToolUse", '"file_path":"a.md","edits":[{"old_string":"x","new_string":"commit를 올립니다"},{"old_string":"y","new_string":"니즈는 이슈입니다"}]'),
    ("Bash", "PostToolUse", '"command":"git commit -m \'이슈를 고칩니다\' -m \'컨텐츠 정리\'"'),
    ("Write", "PreToolUse", '"file_path":"a.md","content":"이슈를 봅니다. https://example.com/이슈"'),
    ("Bash", "PreToolUse", '"command":"git commit -m \'니즈를 봅니다\' && echo 이슈"'),
    ("Write", "PreToolUse", '"file_path":"a.md","content":"이슈 900101-1234567 입니다"'),
    ("Edit", "PreToolUse", '"file_path":"a.md","old_string":"x","new_string":"이슈를 봅니다"'),
    ("Write", "PostToolUse", '"file_path":"robots.txt","content":"레버리지와 니즈를 살핍니다"'),
    ("Write", "PostToolUse", '"file_path":"a.md","content":"plain words and nothing else"'),
    ("Write", "PostToolUse", '"file_path":"a.py","content":"레버리지와 니즈를 살핍니다"'),
]
CALL = "CASE event_id % 10 " + " ".join(f"WHEN {n} THEN '" + ('{"tool_name":"' + t + '","hook_event_name":"' + e + '","tool_input":{' + i + "}}").replace("'", "''") + "'" for n, (t, e, i) in enumerate(CALLS)) + " END"
# By hand, for each of the calls above: findings, particles, decision without and with fixes, and the fixed text.
VERDICTS = [
    (1, 0, "warn", "warn", ""), (2, 1, "warn", "warn", ""), (2, 0, "warn", "warn", ""), (0, 0, "none", "fix", "문제를 봅니다. https://example.com/이슈"),
    (0, 0, "none", "fix", "git commit -m '요구를 봅니다' && echo 이슈"), (0, 0, "deny", "deny", ""), (0, 0, "none", "none", ""), (0, 0, "none", "none", ""), (0, 0, "none", "none", ""), (0, 0, "none", "none", ""),
]


def _calls(spark, d):
    return guard.parsed(table(spark, d, "events").selectExpr("event_id", f"{CALL} AS value")).drop("value")


def tone_verdicts(spark, d):
    out = tone.verdicts(_calls(spark, d), "event_id")
    return out.select("event_id", long(F.col("n_findings")).alias("n_findings"), long(F.col("n_particles")).alias("n_particles"), F.coalesce("decision", F.lit("none")).alias("decision"))


def tone_fixes(spark, d):
    out = tone.verdicts(_calls(spark, d), "event_id", mode=tone.FIX)
    return out.select("event_id", F.coalesce("decision", F.lit("none")).alias("decision"), F.coalesce("updated.content", "updated.command", F.lit("")).alias("text"))


_verdicts = "(VALUES " + ", ".join(f"({n}, {f}, {p}, '{a}', '{b}', '" + t.replace("'", "''") + "')" for n, (f, p, a, b, t) in enumerate(VERDICTS)) + ") AS v(n, f, p, a, b, t)"

BODY = "'### Where' || chr(10) || chr(10) || 'file ' || cast(event_id AS varchar(12)) || chr(10) || chr(10) || '### Why' || chr(10) || chr(10) || CASE WHEN event_id % 2 = 0 THEN '_No response_' ELSE 'because' END || chr(10)"


def issue_form_fields(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", f"{BODY} AS body")
    return review.issue_fields(e, "event_id", "body").select("event_id", "label", "value")


def grader_weighted_score(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") % 10).alias("case"), F.col("role").alias("arm"), F.when(F.col("turn") % 2 == 0, "contains").otherwise("not_contains").alias("type"), (F.col("turn") + 1).cast("double").alias("weight"), F.lit("the|der|les").alias("pattern"), F.col("text").alias("answer"))
    return review.graded(c)


def json_props_masked(spark, d):
    """Real e-mails of the documents, masked."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), 0)).alias("email"))
    return docs.select("doc_id", "email", formats.mask_email(F.col("email")).alias("masked"))


QUERIES = {
    "rrn_detect": (rrn_detect, f"WITH {RRN_HITS} SELECT id, cast(1 AS bigint) AS line, cast(q AS bigint) AS col, length(hit) AS len, hit AS matched FROM r"),
    "rrn_redact": (rrn_redact, f"WITH {RRN_HITS} SELECT d.id, CASE WHEN hit IS NULL THEN d.text ELSE before || regexp_replace(hit, '[^0-9]', '', 'g')[1:6] || '-*******' || substr(d.text, q + length(hit)) END AS text FROM d LEFT JOIN r ON d.id = r.id"),
    "rrn_birth_year": (rrn_birth_year, f"WITH d AS ({RRN_SQL}) SELECT id, cast(year({BIRTH}) AS bigint) AS year FROM d"),
    "glued_time_key_exempt": (glued_time_key_exempt, f"WITH d AS ({RRN_SQL}) SELECT id, starts_with(text, 'created_at: ') AS exempt FROM d WHERE regexp_matches(text, '[0-9]{{13}}')"),
    "merge_spans": (merge_spans, f"WITH o AS ({SPANS}), m AS (SELECT *, coalesce(s >= max(e) OVER (PARTITION BY g ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS nw FROM o), k AS (SELECT *, sum(nw::int) OVER (PARTITION BY g ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT g, min(s) AS s, max(e) AS e FROM k GROUP BY g, k"),
    "mask_people": (mask_people, MASK_SQL),
    "mask_record_struct": (mask_record_struct, MASK_SQL),
    "mask_phone": (mask_phone, f"{PHONES} SELECT id, CASE WHEN length(a) < 9 THEN repeat('*', length(value)) ELSE substr(a, 1, CASE WHEN starts_with(a, '02') THEN 2 ELSE 3 END) || '-****-' || right(a, 4) END AS masked FROM g"),
    "mask_address": (mask_address, record_sql.MASKED_ADDRESSES),
    "phone_kinds": (phone_kinds, f"{PHONES} SELECT id, CASE WHEN ok THEN k ELSE 'none' END AS kind, CASE WHEN NOT ok THEN value WHEN k = 'shared' THEN substr(x, 1, 4) || '-' || substr(x, 5) ELSE substr(x, 1, n) || '-' || substr(x, n + 1, length(x) - n - 4) || '-' || right(x, 4) END AS formatted FROM r2"),
    "phone_international": (phone_international, f"{PHONES} SELECT id, CASE WHEN ok THEN '+82' || regexp_replace(x, '^0', '') ELSE '' END AS number FROM r2"),
    "biz_number_valid": (biz_number_valid, BIZ),
    "address_kind": (address_kind, f"WITH a AS ({ADDRESS_SQL}) SELECT id, CASE WHEN regexp_matches(value, '[로길]\\s*(지하\\s*)?[0-9]+(-[0-9]+)?([^0-9가-]|$)') THEN 'road' WHEN regexp_matches(value, '[동리가]\\s*(산\\s*)?[0-9]+(-[0-9]+)?([^0-9-]|$)') THEN 'lot' ELSE 'unknown' END AS kind FROM a"),
    "address_same": (address_same, record_sql.SAME_ADDRESSES),
    "sort_korean_topn": (sort_korean_topn, "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '나' ELSE 'item' END || cast(p_partkey AS varchar) AS name FROM part) SELECT p_partkey, name FROM p ORDER BY p_partkey % 3 <> 0, p_partkey LIMIT 50"),
    "width_clean": (width_clean, CELL_SQL),
    "business_days_add": (business_days_add, f"WITH c AS (SELECT * FROM {CLOSED_SQL}), cal AS (SELECT cast(x AS date) AS d FROM generate_series(date '2023-12-01', date '2025-12-31', INTERVAL 1 DAY) t(x)), o AS (SELECT d, isodow(d) < 6 AND d NOT IN (SELECT d FROM c) AS op FROM cal), k AS (SELECT *, sum(op::int) OVER (ORDER BY d) AS n FROM o), e AS (SELECT event_id, date '2024-01-01' + cast(event_id % 300 AS int) AS day, event_id % 12 AS n FROM events) SELECT event_id, strftime(CASE WHEN e.n <= 0 THEN day ELSE t.d END, '%Y-%m-%d') AS due FROM e JOIN k ON k.d = e.day LEFT JOIN k t ON t.op AND t.n = k.n + e.n"),
    "bank_closed": (bank_closed, f"SELECT DISTINCT strftime(d, '%Y-%m-%d') AS d FROM (SELECT d FROM {CLOSED_SQL} UNION ALL SELECT make_date(y, 5, 1) FROM range(2023, 2026) r(y))"),
    "kst_daily_events": (kst_daily_events, "SELECT strftime(cast(ts + INTERVAL 9 HOUR AS date), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1"),
    "substitute_holidays": (substitute_holidays, record_sql.substitutes(HOLIDAYS)),
    "links_extract": (links_extract, f"SELECT page_id, cast(l AS bigint) AS line, {TRIMMED} AS url FROM pages, range(1, 3) r(l)"),
    "links_trimmed": (links_trimmed, f"SELECT page_id, {TRIMMED} AS url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages"),
    "links_grouped": (links_grouped, "WITH p AS (SELECT page_id % 7 AS file, page_id AS line, regexp_extract(url, '^https?://[^/]+') AS url FROM pages) SELECT url, count(*) AS n, string_agg(cast(file AS varchar) || ':' || cast(line AS varchar), ',' ORDER BY file, line) AS locations FROM p GROUP BY url"),
    "links_status": (links_status, f"SELECT id, CASE WHEN curl_exit IN (6, 7) OR http_code IN (404, 410) THEN 'dead' WHEN curl_exit <> 0 OR http_code IS NULL OR http_code >= 400 THEN 'unverified' WHEN title = '오류 페이지' THEN 'soft_dead' WHEN title = 'Not Found' THEN 'unverified' ELSE 'ok' END AS status FROM (SELECT {PROBE} FROM pages)"),
    "fingerprints": (fingerprints, "SELECT conv_id, turn, sha1(coalesce(role, '') || '||bad|' || trim(coalesce(text, ''))) AS fp FROM conversations"),
    "review_to_post": (review_to_post, f"WITH {THREADS} SELECT conv_id, turn, fp FROM f WHERE fp NOT IN (SELECT fp FROM t WHERE ours AND NOT res AND NOT old)"),
    "review_to_resolve": (review_to_resolve, f"WITH {THREADS} SELECT DISTINCT thread_id FROM t WHERE ours AND NOT res AND NOT human AND thread_id NOT IN (SELECT thread_id FROM t WHERE ours AND NOT res AND fp IN (SELECT fp FROM f))"),
    "diff_commentable_lines": (diff_commentable_lines, f"{DIFF} SELECT * FROM s"),
    "comments_in_out_diff": (comments_in_out_diff, f"{DIFF} SELECT p.page_id AS filename, p.page_id % 40 + 1 AS line, (p.page_id, p.page_id % 40 + 1) IN (SELECT (page_id, line) FROM s) AS inside FROM pages p"),
    "rule_diff": (rule_diff, DIFF_RULES),
    "rule_impact_top10": (rule_impact_top10, record_sql.impact(rules.RULES, _HEAD)),
    "latency_summary": (latency_summary, "SELECT event_type AS payload, user_id % 2 AS side, round(median(value), 6) AS median, quantile_disc(value, 0.9) AS p90, count(*) AS n FROM events WHERE event_id % 10 >= 2 GROUP BY 1, 2"),
    "latency_regression": (latency_regression, "WITH m AS (SELECT event_type AS payload, median(value) FILTER (WHERE user_id % 2 = 0) AS b, median(value) FILTER (WHERE user_id % 2 = 1) AS h FROM events WHERE event_id % 10 >= 2 GROUP BY 1) SELECT payload, round(h - b, 6) AS delta, h - b >= 10 AND (b <= 0 OR (h - b) / b >= 0.2) AS regression FROM m"),
    "budgeted_body": (budgeted_body, budgeted_sql()),
    "commit_targets": (commit_targets, record_sql.commit_targets(MESSAGES)),
    "guard_decisions": (guard_decisions, "SELECT event_id, cast(CASE WHEN event_id % 6 < 2 THEN 1 ELSE 0 END AS bigint) AS n_pii, cast(CASE WHEN event_id % 6 = 2 THEN 2 ELSE 0 END AS bigint) AS n_tone, CASE WHEN event_id % 6 < 2 THEN 'deny' WHEN event_id % 6 = 2 THEN 'warn' ELSE 'none' END AS decision FROM events"),
    "tone_verdicts": (tone_verdicts, f"SELECT event_id, cast(f AS bigint) AS n_findings, cast(p AS bigint) AS n_particles, a AS decision FROM events JOIN {_verdicts} ON event_id % 10 = n"),
    "tone_fixes": (tone_fixes, f"SELECT event_id, b AS decision, t AS text FROM events JOIN {_verdicts} ON event_id % 10 = n"),
    "issue_form_fields": (issue_form_fields, "SELECT event_id, 'Where' AS label, 'file ' || cast(event_id AS varchar) AS value FROM events UNION ALL SELECT event_id, 'Why', CASE WHEN event_id % 2 = 0 THEN '' ELSE 'because' END FROM events"),
    "grader_weighted_score": (grader_weighted_score, "SELECT conv_id % 10 AS \"case\", role AS arm, round(sum(CASE WHEN regexp_matches(text, 'the|der|les') = (turn % 2 = 0) THEN turn + 1.0 ELSE 0 END) / sum(turn + 1.0), 6) AS score FROM conversations GROUP BY 1, 2"),
    "document_emails_masked": (json_props_masked, "WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) AS email FROM documents), l AS (SELECT *, length(string_split(email, '@')[1]) AS n FROM e) SELECT doc_id, email, CASE WHEN n <= 2 THEN repeat('*', n) || substr(email, n + 1) ELSE substr(email, 1, 2) || repeat('*', n - 2) || substr(email, n + 1) END AS masked FROM l"),
}
