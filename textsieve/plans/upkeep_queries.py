"""Queries over rule upkeep, versions, reports and published text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import masks, notes, reports, review, rules, stats, triage
from . import record_sql, scan_sql
from .derived import KO_SQL, count, ko_docs, long, md_docs, table
from .record_queries import _HEAD, DIFF_RULES, _values
from .text_queries import _q

TABLE = "\n".join(["# rules", "| 원어 | 안 쓸 말 | 쓸 말 | 이유 | 검사 | 우선 |", "|---|---|---|---|---|---|"] + [f"| {r[0]} | {r[1]} | {r[2]} | {r[3]} | {r[4]} | {r[5]} |" for r in rules.RULES])


def _tables(spark):
    return spark.createDataFrame([("base", TABLE)], "source string, text string")


def rule_table_parsed(spark, d):
    return rules.parse_tables(_tables(spark)).where("valid").select(long(F.col("line")).alias("line"), "bad", "good", "check", "priority")


def rule_locations(spark, d):
    rows = rules.rules_frame(spark).select(F.lit("base").alias("source"), "bad")
    return triage.rule_locations(rows, _tables(spark)).select("bad", "line")


def finding_owners(spark, d):
    found = rules.rules_frame(spark, _HEAD).select("bad", "good", "check")
    return triage.owners(found, rules.rules_frame(spark)).select("bad", F.coalesce("source", F.lit("none")).alias("owner"))


def prompt_matches(spark, d):
    return triage.prompt_matches(ko_docs(spark, d).select("doc_id", "text"), rules.RULES).select("doc_id", "bad")


def bearable_checks(spark, d):
    rows = [(r[1], triage.bearable_check(r[1], r[2], r[4] != "프롬프트", matches_itself=any(a in r[2] for a in rules.alternatives(r[1])), fixes_probe=True)) for r in rules.RULES]
    return spark.createDataFrame(rows, "bad string, bears string")


def report_labels(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "missed-expression").otherwise("false-positive").alias("t"), F.when(F.col("event_id") % 3 == 0, "style").otherwise("lint").alias("m"), (F.col("event_id") % 5 % 2).alias("n"), (F.col("event_id") % 7 == 0).alias("r"))
    return e.select("event_id", F.array_join(triage.report_labels(F.col("t"), F.col("m"), F.col("n"), F.col("r")), ",").alias("labels"))


def body_transitions(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    pick = lambda n, k: c.where(F.col("key") % n == k)
    return triage.transitions(c.where("key % 11 <> 0"), c.where("key % 13 <> 0"), pick(2, 0), pick(3, 0), pick(5, 0))


VER = "cast(event_id % 3 AS varchar(9)) || '.' || cast(event_id % 4 AS varchar(9)) || CASE WHEN event_id % 10 = 0 THEN '' ELSE '.' || cast(event_id % 12 AS varchar(9)) END"
BASE = "'1.' || cast(event_id % 5 AS varchar(9)) || '.3'"


def versions(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", f"{VER} AS v", f"{BASE} AS b")
    level = F.when(F.col("event_id") % 2 == 0, "minor").otherwise("patch")
    problem = triage.version_problem(F.col("v"), F.col("v"), F.col("b"), F.concat(F.when(F.col("event_id") % 6 == 0, F.lit("x ")).otherwise(F.lit("")), F.col("v"), F.lit(" — said")))
    return e.select("event_id", F.coalesce(triage.next_version(F.col("v"), level), F.lit("none")).alias("next"), F.coalesce(problem, F.lit("ok")).alias("problem"))


def latest_subject_language(spark, d):
    """Of each user's last 40 subjects: what they are written in."""
    e = table(spark, d, "events").selectExpr("user_id % 50 AS repo", "ts", "event_id", "CASE event_id % 4 WHEN 0 THEN '고침 둘' WHEN 1 THEN 'Merge branch x' WHEN 2 THEN 'fix a thing' ELSE '더함 셋' END AS subject")
    w = Window.partitionBy("repo").orderBy(F.desc("ts"), F.desc("event_id"))
    last = e.withColumn("n", F.row_number().over(w)).where("n <= 40")
    return stats.language_by(last, "repo", "subject")


MD = "'[a](docs/x.md#top) `[b](c.md)` [d](' || url || ') [e](' || cast(page_id AS varchar(9)) || '.md) [f](#g)'"


def links_rewritten(spark, d):
    p = table(spark, d, "pages").selectExpr("page_id", f"{MD} AS md")
    return p.select("page_id", triage.rewrite_links(F.col("md"), {"docs/x.md": "X"}, "https://example.org/blob/").alias("md"))


def size_guard(spark, d):
    return triage.within_size(table(spark, d, "documents").select("doc_id", "source", "text"), "source", "text", 110_000).select("doc_id", "fixable")


def rank_points(spark, d):
    r = table(spark, d, "events").select(F.col("event_type").alias("condition"), (F.col("event_id") % 4 + 1).alias("rank"))
    return triage.rank_scores(r)


def section_counts(spark, d):
    c = table(spark, d, "conversations").select(F.col("role").alias("section"))
    return triage.section_counts(c, ["user", "assistant", "system"])


def edit_contexts(spark, d):
    docs = masks.masked(ko_docs(spark, d))
    return docs.select("doc_id", triage.edit_context(F.col("text"), F.col("masked"), F.lit("`이슈`"), masks.MARK).alias("context"))


def code_spans(spark, d):
    p = table(spark, d, "pages").selectExpr("page_id", "repeat('`', cast(page_id % 4 AS int)) || 'x' AS t")
    return p.select("page_id", review.code_span(F.col("t")).alias("code"))


def cut_reports(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", long(F.octet_length(triage.cut_to_bytes(F.col("text"), 600))).alias("n_bytes"))


def doc_language(spark, d):
    docs = table(spark, d, "customer").selectExpr("c_custkey AS repo", "inline(array(struct('README.md' AS path, CASE c_custkey % 4 WHEN 0 THEN repeat('한글 글자 ', 40) WHEN 1 THEN '짧은 글' WHEN 2 THEN NULL ELSE repeat('--- 1 ', 60) END AS text), struct('CONTRIBUTING.md' AS path, repeat('some plain words ', 20) AS text)))")
    return reports.doc_language(docs)


def fixed_texts(spark, d):
    return reports.fix_texts(masks.without_ignored(md_docs(spark, d)), rules.RULES, ext_col="ext").select("doc_id", "fixed")


def findings_by_line(spark, d):
    docs = ko_docs(spark, d).select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n")).alias("masked"))
    return reports.findings_by_line(docs, rules.RULES).select("doc_id", "line", "col", "matched", "fixable")


def line_suggestions(spark, d):
    docs = ko_docs(spark, d).select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n")).alias("masked"))
    return reports.line_suggestions(reports.findings_by_line(docs, rules.RULES))


def imported_rules(spark, d):
    raw = table(spark, d, "part").selectExpr("p_partkey AS ord", "CASE p_partkey % 5 WHEN 0 THEN 'odd' ELSE 'terms' END AS category", "concat('a|', cast(p_partkey % 300 AS string)) AS bad", "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('b', chr(10), cast(p_partkey AS string)) END AS good", "CASE p_partkey % 3 WHEN 0 THEN '핵심' ELSE 'x' END AS priority")
    return reports.import_rules(raw, ["terms"]).select("ord", "bad", "good", "priority")


def rules_in_text(spark, d):
    return reports.rules_in_text(rules.rules_frame(spark), F.lit(TABLE.replace("|  |", "| — |").replace("| 컨텐츠 |", "| 콘텐트 |"))).select("bad")


def issue_values(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "'### Where' || chr(10) || 'f' || cast(event_id AS string) || chr(10) || CASE WHEN event_id % 2 = 0 THEN '### Why' || chr(10) || 'w' ELSE '' END AS body")
    return reports.issue_values(review.issue_fields(e, "event_id", "body"), "event_id", {"place": "Where", "reason": "Why"})


def link_report(spark, d):
    p = table(spark, d, "pages").selectExpr("url", "page_id", "CASE page_id % 3 WHEN 0 THEN 'dead' WHEN 1 THEN 'unverified' ELSE 'ok' END AS status")
    places = F.transform(F.sequence(F.lit(1), F.col("page_id") % 8 + 1), lambda i: F.struct(F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("file"), i.alias("line")))
    return notes.link_report(p.withColumn("locations", places))


_LINKS = """WITH p AS (SELECT *, '- <' || url || '> ' || array_to_string(list_transform(range(1, least(page_id % 8 + 1, 5) + 1), lambda i: 'f' || page_id || ':' || i), ', ')
  || CASE WHEN page_id % 8 + 1 > 5 THEN ' and ' || (page_id % 8 - 4) || ' more' ELSE '' END AS line FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id % 3 ORDER BY url, line) AS n, count(*) OVER (PARTITION BY page_id % 3) AS c FROM p WHERE page_id % 3 < 2),
s AS (SELECT page_id % 3 AS k, '## ' || CASE page_id % 3 WHEN 0 THEN 'dead' ELSE 'unverified' END || ' (' || any_value(c) || ')' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY n) FILTER (WHERE n <= 30)
  || CASE WHEN any_value(c) > 30 THEN chr(10) || '- and ' || (any_value(c) - 30) || ' more' ELSE '' END || chr(10) AS body FROM r GROUP BY 1)
SELECT '# Links' || chr(10) || chr(10) || string_agg(body, chr(10) ORDER BY k) AS body FROM s"""


def review_bodies(spark, d):
    found = table(spark, d, "pages").selectExpr("CASE page_id % 3 WHEN 0 THEN '이슈' WHEN 1 THEN '니즈' ELSE '`코드`' END AS bad", "'말' AS good", "concat('f', cast(page_id % 7 AS string)) AS filename", "page_id AS line")
    return notes.review_body(found)


_REVIEW = """WITH f AS (SELECT CASE page_id % 3 WHEN 0 THEN '`이슈`' WHEN 1 THEN '`니즈`' ELSE '```코드```' END AS code, CASE WHEN page_id % 3 = 2 THEN '``' || '`코드`' || '``' END AS fenced, 'f' || (page_id % 7) AS filename, page_id AS line FROM pages),
k AS (SELECT coalesce(fenced, code) AS code, count(*) AS n, min((filename, line)) AS first FROM f GROUP BY 1)
SELECT '# Expressions' || chr(10) || chr(10) || '## Kinds (' || count(*) || ')' || chr(10) || chr(10) || string_agg('- ' || code || ' → `말`' || CASE WHEN n > 1 THEN ' (' || n || ' times)' ELSE '' END, chr(10) ORDER BY first) || chr(10) AS body FROM k"""


def latency_reports(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = e.select(F.col("event_type").alias("payload"), (F.col("n") / 8).alias("base"), (F.col("n") / 4).alias("head"))
    return notes.latency_report(rows.withColumn("regression", stats.is_regression(F.col("base"), F.col("head")) & (F.length("payload") > 5)))


_LATENCY = """WITH e AS (SELECT event_type AS p, count(*) AS n FROM events GROUP BY 1), l AS (SELECT p, '- ' || p || ': ' || cast(round(n / 8, 1) AS varchar) || ' ms to ' || cast(round(n / 4, 1) AS varchar) || ' ms' AS line, n / 8 >= 10 AND length(p) > 5 AS slow FROM e),
s AS (SELECT slow, '## ' || CASE WHEN slow THEN 'Slower' ELSE 'Others' END || ' (' || count(*) || ')' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY p) || chr(10) AS body FROM l GROUP BY slow)
SELECT '# Latency' || chr(10) || chr(10) || string_agg(body, chr(10) ORDER BY slow DESC) AS body FROM s"""


def impact_reports(spark, d):
    base, head = rules.rules_frame(spark), rules.rules_frame(spark, _HEAD)
    counts = table(spark, d, "part").selectExpr("'terms' AS source", "concat('r', cast(p_partkey AS string)) AS bad", "p_partkey AS before", "p_size + 0L AS after").where("before <> after")
    moves = table(spark, d, "nation").selectExpr("n_name AS key", "CASE WHEN n_nationkey % 2 = 0 THEN 'entered' ELSE 'left' END AS move")
    return notes.impact_report(rules.diff_rules(base, head), counts, moves)


_IMPACT = f"""WITH c AS (SELECT 'r' || p_partkey AS bad, p_partkey AS b, cast(p_size AS bigint) AS h FROM part WHERE p_partkey <> p_size),
cn AS (SELECT *, row_number() OVER (ORDER BY abs(h - b) DESC, bad) AS n, count(*) OVER () AS c FROM c),
d AS ({DIFF_RULES}), m AS (SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'entered' ELSE 'left' END AS move FROM nation),
s AS (SELECT 1 AS k, '## Rules (' || count(*) || ')' || chr(10) || chr(10) || string_agg('- `' || bad || '` (' || source || '): ' || change || CASE WHEN columns <> '' THEN ' ' || columns ELSE '' END, chr(10) ORDER BY source, bad) || chr(10) AS body FROM d
  UNION ALL SELECT 2, '## Findings (' || any_value(c) || ')' || chr(10) || chr(10) || string_agg('- `' || bad || '` (terms): ' || b || ' to ' || h, chr(10) ORDER BY n) FILTER (WHERE n <= 30) || CASE WHEN any_value(c) > 30 THEN chr(10) || '- and ' || (any_value(c) - 30) || ' more' ELSE '' END || chr(10) FROM cn
  UNION ALL SELECT 3, '## In and out of the document (' || count(*) || ')' || chr(10) || chr(10) || string_agg('- ' || n_name || ' ' || move, chr(10) ORDER BY n_name) || chr(10) FROM m)
SELECT '# Impact of the rules' || chr(10) || chr(10) || string_agg(body, chr(10) ORDER BY k) AS body FROM s"""


def triage_comments(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    found = F.when(F.col("turn") % 2 == 0, F.array(F.lit("이슈"), F.lit("니즈"))).otherwise(F.array().cast("array<string>"))
    return c.select("conv_id", "turn", notes.triage_comment(F.array(F.lit("reproduced")), F.col("text"), found).alias("body"))


def reviews_to_minimize(spark, d):
    r = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("author"), F.concat(F.when(F.col("turn") % 2 == 0, F.lit("<!-- ours -->")).otherwise(F.lit("")), F.col("text")).alias("body"))
    return notes.reviews_to_minimize(r, "assistant", "<!-- ours -->", 2002)


def format_masks(spark, d):
    """Ranges of four formats over the documents' own texts, put among code blocks, front matter and listings."""
    docs = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, FORMATS)), (F.col("doc_id") % len(FORMATS) + 1).cast("int")).alias("ext"), F.expr(FORMATTED).alias("text"))
    ranges = masks.format_ranges(F.col("text"), F.col("ext"))
    return docs.select("doc_id", F.explode(ranges).alias("r")).select("doc_id", long(F.col("r.s")).alias("s"), long(F.col("r.e")).alias("e"))


FORMATS = ["md", "rst", "adoc", "txt"]
_BODY = "replace(replace(text, chr(10), ' '), '<', ' ')"
FORMATTED = f"CASE doc_id % 8 WHEN 0 THEN concat('---', chr(10), 'title: ', {_BODY}, chr(10), '  more', chr(10), 'tags: x', chr(10), '---', chr(10), {_BODY}, chr(10), chr(10), '    code') WHEN 4 THEN concat({_BODY}, chr(10), chr(10), '    code', chr(10), chr(10), '    more', chr(10), '- item', chr(10), chr(10), '    in list', chr(10), '# head', chr(10), chr(9), 'tab') ELSE concat({_BODY}, '::', chr(10), chr(10), '    lit', chr(10), '----', chr(10), 'x', chr(10), '----') END"
_at = lambda before, it: f"SELECT doc_id, cast(length({before}) AS bigint) AS s, cast(length({before}) + length({it}) AS bigint) AS e FROM t"
_LF = "chr(10)"
#: The places in each of the texts above, from the lengths of their parts.
_FORMAT_SQL = f"WITH t AS (SELECT doc_id, {_BODY} AS b FROM documents) " + " UNION ALL ".join(
    f"{_at(before, it)} WHERE doc_id % {n} = {k}"
    for n, k, before, it in [
        (8, 0, "''", "'---' || chr(10)"), (8, 0, "'---' || chr(10)", "'title:'"), (8, 0, "'---.title: ' || b || '...more.'", "'tags: x'"), (8, 0, "'---.title: ' || b || '...more.tags: x.'", "'---'"), (8, 0, "'---.title: ' || b || '...more.tags: x.---.' || b || '..'", "'    code'"),
        (8, 4, "b || '..'", "'    code..    more'"), (8, 4, "b || '..    code..    more.- item..    in list.# head.'", "'.tab'"),
        (4, 1, "''", "b || '::..    lit'"), (4, 2, "b || '::..    lit.'", "'----.x.----'"),
    ]
)


_rows = [(n + 4, r) for n, r in enumerate(rules.RULES)]
QUERIES = {
    "rule_table_parsed": (rule_table_parsed, "SELECT cast(line AS bigint) AS line, bad, good, \"check\", priority FROM (VALUES " + ", ".join(f"({n - 1}, {_q(r[1])}, {_q(r[2])}, {_q(r[4])}, {_q(r[5])})" for n, r in _rows) + ') AS t(line, bad, good, "check", priority)'),
    "rule_locations": (rule_locations, "SELECT bad, cast(line AS bigint) AS line FROM (VALUES " + ", ".join(f"({_q(r[1])}, {n})" for n, r in _rows) + ") AS t(bad, line)"),
    "finding_owners": (finding_owners, f'SELECT h.bad, coalesce(r.source, \'none\') AS owner FROM {_values(_HEAD).replace("AS r(", "AS h(")} LEFT JOIN {_values(rules.RULES)} ON h.bad = r.bad AND h.good = r.good AND h."check" = r."check"'),
    "prompt_matches": (prompt_matches, f"WITH k AS ({KO_SQL}) SELECT doc_id, '데이터베이스' AS bad FROM k WHERE contains(text, '데이터베이스')"),
    "bearable_checks": (bearable_checks, record_sql.bearable(rules.RULES)),
    "report_labels": (report_labels, "WITH e AS (SELECT event_id, event_id % 3 <> 0 AS lint, CASE WHEN event_id % 2 = 0 THEN event_id % 5 % 2 = 0 ELSE event_id % 5 % 2 > 0 END AS shows, event_id % 7 = 0 AS r FROM events) SELECT event_id, concat_ws(',', CASE WHEN lint THEN CASE WHEN shows THEN 'reproduced' ELSE 'not-reproduced' END END, CASE WHEN r THEN 'needs-info' END) AS labels FROM e"),
    "body_transitions": (body_transitions, "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'entered' ELSE 'left' END AS move, c_custkey % 5 = 0 AS changed FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND (c_custkey % 2 = 0) <> (c_custkey % 3 = 0)"),
    "versions": (versions, "WITH e AS (SELECT event_id, event_id % 3 AS a, event_id % 4 AS b, event_id % 12 AS c, event_id % 10 <> 0 AS ok, event_id % 5 AS m FROM events) SELECT event_id, CASE WHEN NOT ok THEN 'none' WHEN event_id % 2 = 0 THEN a || '.' || (b + 1) || '.0' ELSE a || '.' || b || '.' || (c + 1) END AS next, CASE WHEN NOT ok THEN 'invalid-version' WHEN (a, b, c) <= (1, m, 3) THEN 'version-not-bumped' WHEN event_id % 6 = 0 THEN 'subject-format' ELSE 'ok' END AS problem FROM e"),
    "latest_subject_language": (latest_subject_language, "WITH n AS (SELECT user_id % 50 AS repo, event_id % 4 AS k, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts DESC, event_id DESC) AS n FROM events), s AS (SELECT repo, avg(CASE WHEN k IN (0, 3) THEN 1.0 ELSE 0.0 END) AS share, count(*) AS c FROM n WHERE n <= 40 AND k <> 1 GROUP BY repo) SELECT repo, round(share, 6) AS share, c AS n_samples, CASE WHEN c < 3 THEN 'unknown' WHEN share >= 0.6 THEN 'korean' WHEN share <= 0.1 THEN 'english' ELSE 'mixed' END AS language FROM s"),
    "links_rewritten": (links_rewritten, "SELECT page_id, '[a](X#top) `[b](c.md)` [d](' || url || ') [e](https://example.org/blob/' || cast(page_id AS varchar) || '.md) [f](#g)' AS md FROM pages"),
    "size_guard": (size_guard, "SELECT doc_id, sum(length(text)) OVER (PARTITION BY source) <= 110000 AS fixable FROM documents"),
    "rank_points": (rank_points, "SELECT event_type AS condition, cast(sum(4 - event_id % 4) AS bigint) AS points FROM events GROUP BY 1"),
    "section_counts": (section_counts, "SELECT count(*) FILTER (WHERE role = 'user') AS \"user\", count(*) FILTER (WHERE role = 'assistant') AS assistant, count(*) FILTER (WHERE role = 'system') AS system FROM conversations"),
    "edit_contexts": (edit_contexts, f"WITH k AS ({KO_SQL}) SELECT doc_id, CASE WHEN contains(text, '`이슈`') THEN 'exempt' ELSE 'unknown' END AS context FROM k"),
    "code_spans": (code_spans, "SELECT page_id, repeat('`', page_id % 4 + 1) || repeat('`', page_id % 4) || 'x' || repeat('`', page_id % 4 + 1) AS code FROM pages"),
    "cut_reports": (cut_reports, "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), s AS (SELECT doc_id, sum(strlen(ln) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM l) SELECT doc_id, cast(coalesce(max(n) FILTER (WHERE n <= 600), 0) AS bigint) AS n_bytes FROM s GROUP BY doc_id"),
    "doc_language": (doc_language, "SELECT c_custkey AS repo, CASE c_custkey % 4 WHEN 0 THEN 'korean' WHEN 1 THEN 'english' ELSE 'unknown' END AS language FROM customer"),
    "fixed_texts": (fixed_texts, scan_sql.FIXED_TEXTS),
    "findings_by_line": (findings_by_line, scan_sql.FINDINGS_BY_LINE),
    "line_suggestions": (line_suggestions, scan_sql.SUGGESTIONS),
    "link_report": (link_report, _LINKS),
    "review_body": (review_bodies, _REVIEW),
    "latency_report": (latency_reports, _LATENCY),
    "impact_report": (impact_reports, _IMPACT),
    "triage_comment": (triage_comments, "SELECT conv_id, turn, 'Labels: reproduced' || chr(10) || chr(10) || '> ' || replace(CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '…' ELSE text END, chr(10), chr(10) || '> ') || chr(10) || chr(10) || CASE WHEN turn % 2 = 0 THEN '- `이슈`' || chr(10) || '- `니즈`' ELSE 'Nothing found.' END AS body FROM conversations"),
    "reviews_to_minimize": (reviews_to_minimize, "SELECT conv_id * 1000 + turn AS id FROM conversations WHERE role = 'assistant' AND (turn % 2 = 0 OR contains(text, '<!-- ours -->')) AND conv_id * 1000 + turn <> 2002"),
    "format_masks": (format_masks, _FORMAT_SQL),
    "imported_rules": (imported_rules, "WITH r AS (SELECT p_partkey AS ord, 'a' || chr(92) || '|' || cast(p_partkey % 300 AS varchar) AS bad, 'b ' || cast(p_partkey AS varchar) AS good, CASE p_partkey % 3 WHEN 0 THEN '핵심' ELSE '보통' END AS priority FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0) SELECT ord, bad, good, priority FROM (SELECT *, row_number() OVER (PARTITION BY bad ORDER BY ord) AS n FROM r) WHERE n = 1"),
    "rules_in_text": (rules_in_text, "SELECT bad FROM (VALUES " + ", ".join(f"({_q(r[1])})" for r in rules.RULES if r[1] != "컨텐츠") + ") AS t(bad)"),
    "issue_values": (issue_values, "SELECT event_id, 'f' || cast(event_id AS varchar) AS place, CASE WHEN event_id % 2 = 0 THEN 'w' ELSE '' END AS reason FROM events"),
}
