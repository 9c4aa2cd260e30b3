"""SQL of single queries over words, addresses, holidays, reports and commands, in statements that DuckDB runs."""

from __future__ import annotations

from ..functions import formats, particles, workdays
from ..operators import rules, stats, triage
from .derived import ADDRESS_SQL, KO_SQL
from .scan_sql import _q, right_form, statement, word_sound

_any = lambda names: "|".join(sorted(names, key=lambda n: (-len(n), n)))
_map = lambda values: "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in values.items()) + "}"
_list = lambda names: "[" + ", ".join(map(_q, names)) + "]"


def final_sounds(words: list[str], asked: list[str]) -> str:
    correct = right_form("snd", "particle")
    unsure = f"regexp_matches(word, '^[0-9]+$') AND list_contains({_list(particles.NOT_AFTER_NUMBERS)}, particle)"
    return f"""SELECT word, particle, coalesce(snd, '?') AS final, CASE WHEN {unsure} THEN '' ELSE coalesce({correct}, '') END AS correct
FROM (SELECT *, {word_sound('word')} AS snd FROM (SELECT unnest({_list(words)}) AS word), (SELECT unnest({_list(asked)}) AS particle))"""


_VERB = f"^(?i)({_any(stats.VERBS)})({_any(stats.ENDINGS)})"
LATIN_VERBS = f"""WITH k AS ({KO_SQL}), p AS (SELECT doc_id, text, q - 1 AS start, regexp_extract(substr(text, q, 40), '{_VERB}', 1) AS verb, regexp_extract(substr(text, q, 40), '{_VERB}', 2) AS ending FROM (SELECT *, unnest(range(1, length(text) + 1)) AS q FROM k)),
h AS (SELECT *, substr(text, 1, cast(start AS bigint)) AS before FROM p WHERE verb <> '')
SELECT doc_id, start, verb || ending AS hit, {_map(stats.VERBS)}[lower(verb)] || ending AS good FROM h
WHERE NOT regexp_matches(before, '[A-Za-z0-9_.:/@$\\\\\\x01-]$') AND NOT regexp_matches(before, '[A-Za-z0-9\\x01][ \\t]$')"""

_HANGUL = "[가-힣ᄀ-ᇿ㄰-㆏]"
STYLE = f"""WITH k AS ({KO_SQL}), c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '<!--.*?-->', '', 'gs'), '```.*?```', '', 'gs'), '`[^`]*`', 'X', 'g') AS clean FROM k),
l AS (SELECT doc_id, trim(unnest(string_split(clean, chr(10)))) AS line FROM c),
i AS (SELECT doc_id, regexp_matches(line, '^([-*•]|\\d+[.)])\\s+') AS item, replace(regexp_replace(line, '^([-*•]|\\d+[.)])\\s+', ''), '**', '') AS body FROM l WHERE line <> '' AND NOT regexp_matches(line, '^(#|\\||[-*_]{{3,}}$)')),
s AS (SELECT doc_id, item, regexp_replace(unnest(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2))), '[.!?:)\\]"''”’\\s]+$', '') AS s FROM i),
n AS (SELECT *, len(regexp_extract_all(s, '{_HANGUL}')) AS n, regexp_extract_all(s, '[가-힣]')[-1] IN ('다', '요', '죠', '까', '네') AS ended, regexp_matches(s, '(함|됨|음|임|필요|완료|예정|가능|불가|없음|있음|확인|통과|수정|추가|제거|변경|적용|누락)$') AS noun FROM s),
p AS (SELECT doc_id, count(*) FILTER (WHERE NOT item) AS prose, count(*) FILTER (WHERE NOT item AND NOT ended) AS prose_no_ending, count(*) FILTER (WHERE item) AS items, count(*) FILTER (WHERE item AND NOT ended) AS items_no_ending,
  count(*) FILTER (WHERE noun) AS noun_endings, round(avg(n), 1) AS mean_length FROM n WHERE n >= 4 GROUP BY doc_id)
SELECT c.doc_id, cast(len(regexp_extract_all(clean, '—')) AS bigint) AS dashes, round(len(regexp_extract_all(clean, '[가-힣]의\\s')) / greatest(len(regexp_extract_all(clean, '{_HANGUL}')), 1) * 1000, 1) AS ui_per_1000,
  {', '.join(f'coalesce({x}, 0) AS {x}' for x in ('prose', 'prose_no_ending', 'items', 'items_no_ending', 'noun_endings'))}, coalesce(mean_length, 0.0) AS mean_length FROM c LEFT JOIN p USING (doc_id)"""

_NAMES = _any(formats.CANONICAL)
_UNSEEN = lambda p: p.replace("(?![0-9가호동층길-])", "([^0-9가호동층길-]|$)").replace("(?![0-9호동층-])", "([^0-9호동층-]|$)")
_REST = lambda p: f"CASE WHEN trim(substr(t, length({p}) + 1)) = '' THEN {p} ELSE {p} || ' ****' END"
MASKED_ADDRESSES = f"""WITH a AS ({ADDRESS_SQL}), t AS (SELECT id, trim(value) AS t FROM a),
r AS (SELECT *, regexp_extract(t, '{_UNSEEN(formats.ROAD)}', 1) AS road, regexp_extract(t, '{_UNSEEN(formats.LOT)}', 1) AS lot, regexp_extract(t, '^({_NAMES})', 1) AS region, regexp_extract(t, '^((?:{_NAMES})(?:\\s+[^0-9\\s]*[시군구])*)(\\s|$)', 1) AS parts FROM t),
p AS (SELECT *, regexp_replace(CASE WHEN parts <> '' THEN parts ELSE region END, '\\s+', ' ', 'g') AS place FROM r)
SELECT id, CASE WHEN road <> '' THEN {_REST('road')} WHEN lot <> '' THEN {_REST('lot')} WHEN place = '' THEN '****' WHEN place = t THEN place ELSE place || ' ****' END AS masked FROM p"""

#: Spaces between numbers are put aside, the others go.
SAME_ADDRESSES = f"""WITH a AS ({ADDRESS_SQL}), b AS (SELECT id, regexp_replace(trim(regexp_replace(trim(value), '[(][^()]*[)]$', '')), '\\s+', ' ', 'g') AS base FROM a),
n AS (SELECT *, regexp_extract(base, '^({_NAMES})', 1) AS name FROM b),
j AS (SELECT id, CASE WHEN name = '' THEN base ELSE {_map(formats.CANONICAL)}[name] || ' ' || substr(base, length(name) + 1) END AS j FROM n),
k AS (SELECT id, replace(regexp_replace(regexp_replace(regexp_replace(j, '([0-9])\\s+([0-9])', '\\1' || chr(2) || '\\2', 'g'), '([0-9])\\s+([0-9])', '\\1' || chr(2) || '\\2', 'g'), '\\s+', '', 'g'), chr(2), ' ') AS k FROM j)
SELECT k, min(id) AS first_id, count(*) AS n FROM k GROUP BY k"""


def substitutes(holidays: list[tuple[str, str]]) -> str:
    """A date after the other; the first free weekday within thirty days is taken, or a day given already is used up."""
    rows = ", ".join(f"(DATE '{d}', {_q(n)}, {i})" for i, (d, n) in enumerate(holidays))
    sunday, weekend = _list(sorted(workdays.SUNDAY_ONLY)), _list(sorted(workdays.WEEKEND))
    name = f"CASE WHEN name = '근로자의 날' AND year(d) >= 2026 THEN '노동절' ELSE coalesce({_map(workdays.ALIASES)}[name], name) END"
    parts = [
        f"h AS (SELECT * FROM (VALUES {rows}) AS t(d, name, i))",
        f"c AS (SELECT d, {name} AS name, min(i) AS i FROM h GROUP BY 1, 2)",
        f"""g AS (SELECT d, count(*) AS n_names, list(name ORDER BY i) FILTER (WHERE list_contains({sunday} || {weekend}, name)) AS moved,
  bool_or(CASE WHEN list_contains({sunday}, name) THEN isodow(d) = 7 ELSE list_contains({weekend}, name) AND isodow(d) >= 6 END) AS falls FROM c GROUP BY d)""",
        "todo AS (SELECT d, moved, row_number() OVER (ORDER BY d) AS rk FROM g WHERE moved IS NOT NULL AND (n_names > 1 OR falls))",
        f"""s AS (SELECT cast(0 AS bigint) AS rk, (SELECT list(DISTINCT d) FROM h) AS taken, (SELECT coalesce(list(DISTINCT d), []) FROM h WHERE name = {_q(workdays.SUBSTITUTE)}) AS given, []::STRUCT(d DATE, f VARCHAR)[] AS made
  UNION ALL SELECT rk, CASE WHEN free THEN list_append(taken, day) ELSE taken END, CASE WHEN free THEN given ELSE list_filter(given, lambda x: x IS DISTINCT FROM day) END,
    CASE WHEN free THEN list_append(made, struct_pack(d := day, f := array_to_string(moved, ', '))) ELSE made END
  FROM (SELECT *, day IS NOT NULL AND NOT list_contains(given, day) AS free FROM (SELECT t.rk, t.moved, s.taken, s.given, s.made,
    list_filter(list_transform(range(1, 31), lambda k: cast(t.d + cast(k AS int) AS date)), lambda x: list_contains(s.given, x) OR (isodow(x) < 6 AND NOT list_contains(s.taken, x)))[1] AS day FROM s JOIN todo t ON t.rk = s.rk + 1)))""",
    ]
    made = f"SELECT strftime(m.d, '%Y-%m-%d') AS date, {_q(workdays.SUBSTITUTE)} AS name, m.f AS substitute_for FROM (SELECT unnest(made) AS m FROM (SELECT made FROM s ORDER BY rk DESC LIMIT 1))"
    return statement(parts, f"SELECT strftime(d, '%Y-%m-%d') AS date, name, NULL AS substitute_for FROM h UNION ALL {made}")


def impact(base, head) -> str:
    def counted(of, name):
        rows = ", ".join(f"({_q(r[7])}, {_q(r[1])})" for r in of if r[4] != "프롬프트")
        return f"{name} AS (SELECT source, bad, cast(sum((length(text) - length(replace(text, bad, ''))) // length(bad)) AS bigint) AS n FROM k JOIN (VALUES {rows}) AS r(source, bad) ON contains(text, bad) GROUP BY 1, 2)"

    return f"""WITH k AS (SELECT doc_id, text FROM ({KO_SQL})), {counted(base, 'b')}, {counted(head, 'h')}
SELECT source, bad, coalesce(b.n, 0) AS before, coalesce(h.n, 0) AS after FROM b FULL JOIN h USING (source, bad) WHERE coalesce(b.n, 0) <> coalesce(h.n, 0)
ORDER BY abs(coalesce(h.n, 0) - coalesce(b.n, 0)) DESC, source, bad LIMIT 10"""


def commit_targets(found: list[list[tuple[int, int, str, str]]]) -> str:
    """found: for each command, by hand, (start, end, text, quote) of its messages."""
    rows = ", ".join(f"({n}, {a}, {b}, {_q(t)}, {_q(q)})" for n, ts in enumerate(found) for a, b, t, q in ts)
    return f"""SELECT event_id, cast(s AS bigint) AS start, cast(e AS bigint) AS "end", t AS text, q AS quote, true AS replaceable FROM events JOIN (VALUES {rows}) AS r(n, s, e, t, q) ON event_id % {len(found)} = n"""


def bearable(of) -> str:
    rows = ", ".join(f"({_q(r[1])}, {_q(r[2])}, {_q(r[4])})" for r in of)
    heads = "[" + particles.HEADS + "]"
    return f"""WITH r AS (SELECT *, trim(trim(bad), '~') AS core, trim(regexp_replace(regexp_replace(string_split_regex(trim(trim(good), '~'), '\\s*[/|,]\\s*')[1], '\\s*[(][^)]*[)]\\s*', ' ', 'g'), '\\s+', ' ', 'g')) AS first FROM (VALUES {rows}) AS t(bad, good, chk)),
w AS (SELECT *, length(core) > {triage.MAX_SUBSTITUTE} OR regexp_matches(good, '{rules.META.pattern}') OR contains(core, '~') OR contains(core, ' / ') OR first = '' OR regexp_matches(first, '[~(),/|]')
  OR (starts_with(ltrim(good), '~') AND regexp_matches(first, '^{heads}')) OR len(list_filter(string_split(core, ' / '), lambda a: contains(good, trim(a)))) > 0 AS weak FROM r)
SELECT bad, CASE WHEN chk = '프롬프트' OR core = '' OR length(core) > {triage.MAX_PATTERN} THEN '프롬프트' WHEN weak THEN '정규식' ELSE '치환' END AS bears FROM w"""
