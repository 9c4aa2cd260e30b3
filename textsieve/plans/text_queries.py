"""Queries over derived Korean texts: rule scan, masks, language, particles, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hangul, particles
from ..operators import masks, rules, scan, stats
from ..operators.positions import matches, merge_spans, spans
from . import record_sql, scan_sql
from .derived import IGNORE, KO_SQL, count, ko_docs, long, long_docs, md_docs, table

ALTS = rules.rule_alternatives(rules.RULES)
PLAIN = [a for a in ALTS if not a["wild"]]
_q = lambda s: "'" + str(s).replace("'", "''") + "'"
_b = lambda v: "true" if v else "false"
#: Alternatives without a wildcard as a VALUES list.
ALT_SQL = "(VALUES " + ", ".join(f"({a['rule_ord']}, {a['alt_ord']}, {_q(a['bad'])}, {_q(a['alt'])}, {_b(a['left'])}, {_b(a['left_digit'])}, {_b(a['right'])}, {_b(a['allow_jeok'])}, {_q(a['source'])})" for a in PLAIN) + ") AS r(rule_ord, alt_ord, bad, alt, lft, lft_digit, rgt, jeok, source)"
KO = f"k AS ({KO_SQL}), a AS (SELECT * FROM {ALT_SQL})"
#: Every place where an alternative stands. None of them overlaps itself.
AT = f"{KO}, p AS (SELECT k.doc_id, k.text, a.*, q - 1 AS start, length(alt) AS len FROM k, a, range(1, 400) t(q) WHERE q <= length(text) AND substr(text, q, length(alt)) = alt)"
FOLLOW = "|".join(sorted(scan.FOLLOWERS, key=lambda t: (-len(t), t)))
BOUND = f"""{AT}, c AS (SELECT *, CASE WHEN start > 0 THEN substr(text, cast(start AS bigint), 1) ELSE '' END AS prev, substr(text, cast(start + len + 1 AS bigint), 12) AS rest FROM p),
b AS (SELECT * FROM c WHERE NOT (lft AND regexp_matches(prev, '^[가-힣ㄱ-ㅎㅏ-ㅣ]')) AND NOT (lft_digit AND regexp_matches(prev, '^[0-9.]')) AND (NOT rgt OR
  CASE WHEN rest = '' OR NOT regexp_matches(rest, '^[가-힣ㄱ-ㅎㅏ-ㅣ]') THEN true
       WHEN regexp_matches(rest, '^(으로|로)') THEN regexp_matches(rest, '^(으로|로)($|[^가-힣ㄱ-ㅎㅏ-ㅣ]|{'|'.join(scan.RO_CONTINUATIONS)})')
       ELSE regexp_matches(rest, '^({FOLLOW})') OR (jeok AND starts_with(rest, '적')) END))"""


def plain_rules():
    return [r if rules.WILDCARD not in rules._strip(r[1]) else (*r[:4], rules.CHECKS[2], *r[5:]) for r in rules.RULES]


def _hits(spark, d):
    return scan.raw_hits(ko_docs(spark, d).withColumnRenamed("text", "masked"), plain_rules())


def rule_hits_by_rule(spark, d):
    hits = _hits(spark, d).groupBy("rule_ord", "alt_ord", "bad").agg(count("n_hits"), long(F.countDistinct("doc_id")).alias("n_docs"))
    return hits.withColumn("rule_ord", long(F.col("rule_ord"))).withColumn("alt_ord", long(F.col("alt_ord")))


def rule_hits_positions(spark, d):
    return _hits(spark, d).select("doc_id", long(F.col("rule_ord")).alias("rule_ord"), "alt", long(F.col("start")).alias("start"))


def rule_hits_bounded(spark, d):
    return scan.within_boundaries(_hits(spark, d)).select("doc_id", long(F.col("rule_ord")).alias("rule_ord"), "alt", long(F.col("start")).alias("start"))


def rule_hits_capped3(spark, d):
    hits = scan.first_per_rule(scan.leftmost_alternative(scan.within_boundaries(_hits(spark, d))), 3, ["doc_id", "bad"])
    return hits.select("doc_id", "bad", long(F.col("start")).alias("start"))


def overlap_resolved(spark, d):
    return scan.lint(masks.masked(ko_docs(spark, d)), rules.RULES, exhaustive=True).select("doc_id", "bad", "alt", long(F.col("start")).alias("start"), long(F.col("len")).alias("len"))


def lint_findings(spark, d):
    docs = masks.masked(masks.without_ignored(ko_docs(spark, d)).where(hangul.looks_korean(F.col("text"))))
    return scan.lint(docs, rules.RULES).select("doc_id", "bad", "good", long(F.col("start")).alias("start"), "matched")


def fixed_docs(spark, d):
    docs = masks.protected(masks.without_ignored(md_docs(spark, d)), ext_col="ext")
    return scan.apply_fixes(docs, rules.RULES, original="text").select("doc_id", "fixed", "n_fixed")


def lint_long(spark, d):
    return scan.lint(masks.masked(long_docs(spark, d)), rules.RULES).select("doc_id", "bad", "good", long(F.col("start")).alias("start"), "matched")


def fixed_long(spark, d):
    docs = masks.protected(long_docs(spark, d).withColumn("ext", F.lit("md")), ext_col="ext")
    return scan.apply_fixes(docs, rules.RULES, original="text").select("doc_id", "fixed", "n_fixed")


def alternatives_exploded(spark, d):
    df = rules.alternatives_frame(spark)
    return df.select(long(F.col("rule_ord")).alias("rule_ord"), long(F.col("alt_ord")).alias("alt_ord"), "alt", "left", "left_digit", "right", "allow_jeok")


def counts_by_check_rollup(spark, d):
    df = rules.rules_frame(spark)
    out = df.rollup("source", "check").agg(count("n"))
    return out.select(F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("check", F.lit("*")).alias("check"), "n")


RULES_SQL = "(VALUES " + ", ".join(f"({i}, {_q(r[1])}, {_q(r[4])}, {_q(r[5])}, {_q(r[7])})" for i, r in enumerate(rules.RULES)) + ') AS r(rule_ord, bad, "check", priority, source)'


def rules_by_priority(spark, d):
    rank = F.array_position(F.array(*map(F.lit, rules.PRIORITIES)), F.col("priority"))
    return rules.rules_frame(spark).select("bad", "priority", long(F.row_number().over(Window.orderBy(rank, "rule_ord"))).alias("place"))


def masked_counts(name):
    pattern = {"inline_code": masks.INLINE_CODE, "html_tags": masks.TAGS, "urls": masks.URLS}[name]

    def run(spark, d):
        found = matches(F.col("html"), pattern)
        return table(spark, d, "pages").withColumn("m", found).select("page_id", long(F.size("m")).alias("n_spans"), long(F.aggregate("m", F.lit(0), lambda a, m: a + F.length(m["hit"]))).alias("n_masked"))

    return run


def masked_counts_sql(pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"SELECT page_id, cast(len(m) AS bigint) AS n_spans, cast(coalesce(list_sum(list_transform(m, lambda x: length(x))), 0) AS bigint) AS n_masked FROM (SELECT page_id, regexp_extract_all(html, '{p}') AS m FROM pages)"


def mask_union_visible_chars(spark, d):
    """Union of three kinds of range; what is visible afterwards."""
    t = F.col("text")
    docs = ko_docs(spark, d)
    ranges = merge_spans(F.concat(*[spans(matches(t, p)) for p in (masks.INLINE_CODE, masks.TAGS, masks.URLS)]))
    gone = F.aggregate(F.col("r"), F.lit(0), lambda a, x: a + x["e"] - x["s"])
    return docs.withColumn("r", ranges).select("doc_id", long(F.length("text") - gone).alias("n_visible"), long(F.size("r")).alias("n_ranges"))


def ignored_docs_dropped(spark, d):
    return masks.without_ignored(ko_docs(spark, d)).groupBy("source").agg(count("n_docs"))


def korean_gate(spark, d):
    docs = ko_docs(spark, d)
    return docs.select("doc_id", long(hangul.count_hangul(F.col("text"))).alias("n_hangul"), hangul.looks_korean(F.col("text")).alias("korean"))


def language_by_source(spark, d):
    return stats.language_by(ko_docs(spark, d), "source", "text")


def hangul_share_docs(spark, d):
    docs = ko_docs(spark, d)
    return docs.select("doc_id", F.round(stats.hangul_share(F.col("text")), 6).alias("share"))


def log_line_nonhangul(spark, d):
    lines = ko_docs(spark, d).select("doc_id", F.posexplode(F.split("text", "[.] ", -1)).alias("pos", "line"))
    return lines.where(hangul.mostly_non_hangul(F.col("line"))).groupBy("doc_id").agg(count("n_lines"))


WORDS = ["commit", "API", "HTTP", "S3", "v1", "10", "7", "server", "unknownword", "URL", "LOCK", "3", "URL2", "x12", "token", "file"]
PARTICLES = ["을", "를", "로", "으로", "이"]


def final_sound_words(spark, d):
    df = spark.createDataFrame([(w, p) for w in WORDS for p in PARTICLES], "word string, particle string")
    return df.select("word", "particle", F.coalesce(particles.word_final_sound(F.col("word")), F.lit("?")).alias("final"), F.coalesce(particles.correct_particle(F.col("word"), F.col("particle")), F.lit("")).alias("correct"))


def particle_errors(spark, d):
    docs = masks.protected(masks.without_ignored(md_docs(spark, d)), ext_col="ext")
    return docs.select("doc_id", F.explode(particles.particle_errors(F.col("masked"), F.col("text"))).alias("e")).select("doc_id", long(F.col("e.start")).alias("start"), "e.matched", "e.correct")


def particle_fix(spark, d):
    docs = masks.protected(md_docs(spark, d), ext_col="ext")
    errors = F.when(F.col("text").rlike(masks.IGNORE_FILE), F.array()).otherwise(particles.particle_errors(F.col("masked"), F.col("text")))
    docs = masks.apart(docs.withColumn("e", errors))
    return docs.select("doc_id", particles.fix_particles(F.col("text"), F.col("e")).alias("text"), long(F.size("e")).alias("n_fixed"))


def latin_verb_hits(spark, d):
    docs = ko_docs(spark, d)
    return docs.select("doc_id", F.explode(stats.latin_verbs(F.col("text"))).alias("m")).select("doc_id", long(F.col("m.start")).alias("start"), "m.hit", "m.good")


def density_per_1000(spark, d):
    found = scan.within_boundaries(_hits(spark, d)).groupBy("doc_id").agg(count("n"))
    docs = ko_docs(spark, d).withColumn("h", hangul.count_hangul(F.col("text"))).join(found, "doc_id", "left")
    return docs.select("doc_id", F.round(F.coalesce("n", F.lit(0)) / F.greatest("h", F.lit(1)) * 1000, 1).alias("density"))


def style_metrics(spark, d):
    return stats.style(ko_docs(spark, d), "doc_id", "text")


def chosung_index(spark, d):
    return ko_docs(spark, d).select("doc_id", hangul.initials(F.col("text")).alias("initials"))


SEARCH = "ㅋㅌㅊ"


def chosung_search(spark, d):
    hit = hangul.search_key(F.col("text")).rlike(hangul.search_pattern(SEARCH))
    return ko_docs(spark, d).where(hit).select("doc_id")


def line_col_lookup(spark, d):
    docs = table(spark, d, "documents")
    places = docs.select("doc_id", "text", F.explode(matches(F.col("text"), "the ")).alias("m"))
    parts = F.split(F.substring("text", 1, F.col("m.start")), "\n", -1)
    return places.select("doc_id", long(F.col("m.start")).alias("start"), long(F.size(parts)).alias("line"), long(F.length(F.element_at(parts, -1)) + 1).alias("col"))


def grouped_counted_top20(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "word"))
    return words.groupBy("word").agg(count("n"), F.min(F.struct("doc_id", "pos")).alias("first")).orderBy(F.desc("n"), "first").limit(20).select("word", "n")


QUERIES = {
    "rule_hits_by_rule": (rule_hits_by_rule, f"WITH {AT} SELECT cast(rule_ord AS bigint) AS rule_ord, cast(alt_ord AS bigint) AS alt_ord, bad, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM p GROUP BY ALL"),
    "rule_hits_positions": (rule_hits_positions, f"WITH {AT} SELECT doc_id, cast(rule_ord AS bigint) AS rule_ord, alt, start FROM p"),
    "rule_hits_bounded": (rule_hits_bounded, f"WITH {BOUND} SELECT doc_id, cast(rule_ord AS bigint) AS rule_ord, alt, start FROM b"),
    "rule_hits_capped3": (rule_hits_capped3, f"WITH {BOUND}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_ord, start ORDER BY alt_ord) AS f FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bad ORDER BY start, rule_ord) AS n FROM f WHERE f = 1) SELECT doc_id, bad, start FROM n WHERE n <= 3"),
    "overlap_resolved": (overlap_resolved, scan_sql.OVERLAPS),
    "lint_findings": (lint_findings, scan_sql.LINT),
    "fixed_docs": (fixed_docs, scan_sql.FIXED),
    "lint_long": (lint_long, scan_sql.LINT_LONG),
    "fixed_long": (fixed_long, scan_sql.FIXED_LONG),
    "alternatives_exploded": (alternatives_exploded, "SELECT cast(rule_ord AS bigint) AS rule_ord, cast(alt_ord AS bigint) AS alt_ord, alt, lft AS \"left\", lft_digit AS left_digit, rgt AS \"right\", jeok AS allow_jeok FROM " + ALT_SQL.rsplit(") AS r", 1)[0] + "".join(f", ({a['rule_ord']}, {a['alt_ord']}, {_q(a['bad'])}, {_q(a['alt'])}, {_b(a['left'])}, {_b(a['left_digit'])}, {_b(a['right'])}, {_b(a['allow_jeok'])}, {_q(a['source'])})" for a in ALTS if a["wild"]) + ") AS r" + ALT_SQL.rsplit(") AS r", 1)[1]),
    "counts_by_check_rollup": (counts_by_check_rollup, f'SELECT coalesce(source, \'*\') AS source, coalesce("check", \'*\') AS "check", count(*) AS n FROM {RULES_SQL} GROUP BY ROLLUP (source, "check")'),
    "rules_by_priority": (rules_by_priority, f"SELECT bad, priority, row_number() OVER (ORDER BY list_position([{', '.join(map(_q, rules.PRIORITIES))}], priority), rule_ord) AS place FROM {RULES_SQL}"),
    "mask_inline_code": (masked_counts("inline_code"), masked_counts_sql(masks.INLINE_CODE)),
    "mask_html_tags": (masked_counts("html_tags"), masked_counts_sql(masks.TAGS)),
    "mask_urls": (masked_counts("urls"), masked_counts_sql(masks.URLS_RE2)),
    "mask_union_visible_chars": (mask_union_visible_chars, f"WITH k AS ({KO_SQL}), m AS (SELECT doc_id, text, regexp_extract_all(text, '{masks.INLINE_CODE}') || regexp_extract_all(text, '{masks.TAGS}') || regexp_extract_all(text, '{masks.URLS_RE2}') AS m FROM k) SELECT doc_id, cast(length(text) - coalesce(list_sum(list_transform(m, lambda x: length(x))), 0) AS bigint) AS n_visible, cast(len(m) AS bigint) AS n_ranges FROM m"),
    "ignored_docs_dropped": (ignored_docs_dropped, f"WITH k AS ({KO_SQL}) SELECT source, count(*) AS n_docs FROM k WHERE NOT contains(text, '{IGNORE}') GROUP BY source"),
    "korean_gate": (korean_gate, f"WITH k AS ({KO_SQL}), h AS (SELECT doc_id, len(regexp_extract_all(text, '[가-힣ᄀ-ᇿ㄰-㆏]')) AS n, length(regexp_replace(text, '\\s', '', 'g')) AS d FROM k) SELECT doc_id, cast(n AS bigint) AS n_hangul, n >= 3 AND n / greatest(d, 1) >= 0.1 AS korean FROM h"),
    "language_by_source": (language_by_source, f"WITH k AS ({KO_SQL}), h AS (SELECT source, len(regexp_extract_all(text, '[가-힣ᄀ-ᇿ㄰-㆏]')) AS n, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM k), s AS (SELECT source, avg(CASE WHEN n >= 2 OR (n = 1 AND l < 3) THEN 1.0 ELSE 0.0 END) AS share, count(*) AS c FROM h WHERE n > 0 OR l >= 3 GROUP BY source) SELECT source, round(share, 6) AS share, c AS n_samples, CASE WHEN c < 3 THEN 'unknown' WHEN share >= 0.6 THEN 'korean' WHEN share <= 0.1 THEN 'english' ELSE 'mixed' END AS language FROM s"),
    "hangul_share_docs": (hangul_share_docs, f"WITH k AS ({KO_SQL}), n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<!--.*?-->', ' ', 'gs'), '`[^`\\n]*`', ' ', 'g'), '<[^>\\n]{{0,300}}>', ' ', 'g'), 'https?://\\S+', ' ', 'g') AS t FROM k), h AS (SELECT doc_id, len(regexp_extract_all(t, '[가-힣ᄀ-ᇿ㄰-㆏]')) AS h, len(regexp_extract_all(t, '[A-Za-z]')) AS l FROM n) SELECT doc_id, round(CASE WHEN h + l = 0 THEN 0.0 ELSE h / (h + l / 2.5) END, 6) AS share FROM h"),
    "log_line_nonhangul": (log_line_nonhangul, f"WITH k AS ({KO_SQL}), l AS (SELECT doc_id, unnest(string_split(text, '. ')) AS ln FROM k), c AS (SELECT doc_id, len(regexp_extract_all(ln, '\\p{{L}}')) AS a, len(regexp_extract_all(ln, '[가-힣]')) AS h FROM l) SELECT doc_id, count(*) AS n_lines FROM c WHERE a = 0 OR h / a < 0.3 GROUP BY doc_id"),
    "final_sound_words": (final_sound_words, record_sql.final_sounds(WORDS, PARTICLES)),
    "particle_errors": (particle_errors, scan_sql.ERRORS),
    "particle_fix": (particle_fix, scan_sql.PUT_RIGHT),
    "latin_verb_hits": (latin_verb_hits, record_sql.LATIN_VERBS),
    "density_per_1000": (density_per_1000, f"WITH {BOUND}, h AS (SELECT doc_id, len(regexp_extract_all(text, '[가-힣ᄀ-ᇿ㄰-㆏]')) AS h FROM k) SELECT h.doc_id, round(coalesce(n, 0) / greatest(h, 1) * 1000, 1) AS density FROM h LEFT JOIN (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id) x USING (doc_id)"),
    "style_metrics": (style_metrics, record_sql.STYLE),
    "chosung_index": (chosung_index, f"WITH k AS ({KO_SQL}) SELECT doc_id, list_aggregate(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN substr('{hangul.INITIALS}', cast((unicode(c) - 44032) // 588 + 1 AS bigint), 1) ELSE c END), 'string_agg', '') AS initials FROM k"),
    "chosung_search": (chosung_search, f"WITH k AS ({KO_SQL}) SELECT doc_id FROM k WHERE regexp_matches(regexp_replace(text, '\\s', '', 'g'), '[ㅋ카-킿][ㅌ타-팋][ㅊ차-칳]')"),
    "line_col_lookup": (line_col_lookup, "WITH p AS (SELECT doc_id, string_split(text, 'the ') AS s, unnest(range(1, len(string_split(text, 'the ')))) AS i FROM documents), q AS (SELECT doc_id, array_to_string(list_slice(s, 1, i), 'the ') AS head FROM p) SELECT doc_id, length(head) AS start, cast(len(string_split(head, chr(10))) AS bigint) AS line, length(string_split(head, chr(10))[-1]) + 1 AS col FROM q"),
    "grouped_counted_top20": (grouped_counted_top20, "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, min((doc_id, pos)) LIMIT 20"),
}
