"""Rule scan, masks, particles, identifiers, formats, calendars, reviews: examples and properties."""

import pytest
from pyspark.sql import functions as F

from textsieve.functions import formats, hangul, particles, workdays
from textsieve.operators import guard, identifiers, masks, record_masking, review, rules, scan, shell, stats
from textsieve.operators.positions import matches, merge_spans, overwrite, rebuild, spans
from textsieve.sources import readers, writers


def one(spark, value, *exprs, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(*[e(F.col("v")).alias(f"c{i}") for i, e in enumerate(exprs)]).first()


# Hangul


def test_final_sounds(spark):
    df = spark.createDataFrame([("가",), ("길",), ("각",), ("a",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(hangul.final_sound(F.col("c"))).collect()] == ["", "ㄹ", "other", None, None, None]
    assert one(spark, "값", lambda c: hangul.decompose(c))[0] == ("ㄱ", "ㅏ", "ㅄ")


def test_initials_and_search(spark):
    import re

    assert one(spark, "한글 ab", hangul.initials)[0] == "ㅎㄱ ab"
    for query, text, hit in [("ㅎㄱ", "한글", True), ("하", "한글", True), ("한ㄱ", "한글", True), ("핝", "한글", False), ("안", "아니", True), ("글한", "한글", False)]:
        assert bool(re.search(hangul.search_pattern(query), text)) == hit, (query, text)
    assert one(spark, "ㅎ ㄱ", hangul.is_initials_query)[0]


def test_normal_forms(spark):
    import unicodedata

    t = "한글 이슈"
    df = spark.createDataFrame([(unicodedata.normalize("NFD", t),), (t,), (None,)], "t string")
    assert [r[0] for r in df.select(hangul.nfc("t")).collect()] == [t, t, None]


def test_width_and_digits(spark):
    r = one(spark, "　ＡＢ１​  x ", hangul.clean_field, lambda c: hangul.check_digit_count(c, 1))
    assert r[0] == "AB1 x" and r[1].ok
    assert one(spark, "1.2E+9", lambda c: hangul.check_digit_count(c, 10))[0].reason == "exponent"
    assert one(spark, "가나다 ab", hangul.looks_korean)[0] and not one(spark, "abc 가", hangul.looks_korean)[0]
    df = spark.createDataFrame([("나10",), ("나2",), ("b",), ("3",)], "t string")
    assert [r[0] for r in df.orderBy(hangul.korean_sort_key(F.col("t"))).collect()] == ["3", "나2", "나10", "b"]
    df = spark.createDataFrame([("a10000000000000",), ("a2000000000000",), ("a0003",), ("a00",)], "t string")
    assert [r[0] for r in df.orderBy(hangul.korean_sort_key(F.col("t"))).collect()] == ["a00", "a0003", "a2000000000000", "a10000000000000"]


# particles


@pytest.mark.parametrize(
    ("text", "fixed"),
    [
        ("commit를 보고 server을 봅니다", "commit을 보고 server를 봅니다"),
        ("API은 URL로 갑니다", "API는 URL로 갑니다"),
        ("URL으로 3를 7으로", "URL로 3을 7로"),
        ("unknown을 LOCK를", "unknown을 LOCK를"),
        ("서버(server)은 값(x)을", "서버(server)는 값(x)을"),
        ("10여야 합니다", "10여야 합니다"),
        ("S3은 v1는", "S3는 v1은"),
    ],
)
def test_particles(spark, text, fixed):
    df = spark.createDataFrame([(text,)], "t string").withColumn("e", particles.particle_errors(F.col("t")))
    out = df.select(particles.fix_particles(F.col("t"), F.col("e")).alias("t"))
    assert out.first()[0] == fixed
    again = out.select(F.size(particles.particle_errors(F.col("t"))))
    assert again.first()[0] == 0


# rules and scan


def test_rule_tables(spark):
    text = "x\n| 원어 | a |\n| 원어 | 나쁨 | 좋음 | 이유 | 검사 | 우선 |\n|---|:--:|---|---|---|---|\n| a | b\\|c | d | [표기] why | 치환 | 핵심 |\n| — | e | f | - | 정규식 | 보통 |\n| g | h | i |\n| g | h | i | j | 없음 | 핵심 |"
    got = rules.parse_tables(spark.createDataFrame([("s", text)], "source string, text string")).orderBy("line").collect()
    assert [(r.bad, r.kind, r.valid) for r in got] == [("b|c", "orthography", True), ("e", None, True), ("h", None, False), ("h", None, False)]
    assert got[0].why == "why" and got[1].en == ""


def findings(spark, text, rows, **options):
    docs = spark.createDataFrame([(1, text)], "doc_id long, masked string")
    return sorted((r.start, r.alt) for r in scan.lint(docs, rows, **options).collect())


def rule(bad, good="새말", check="치환", kind=None):
    return ("", bad, good, "", check, "핵심", kind, "t")


def test_boundaries(spark):
    rows = [rule("이슈")]
    assert findings(spark, "이슈는 대이슈 이슈리더 이슈로 이슈로봇 이슈, 이슈", rows) == [(0, "이슈"), (13, "이슈"), (22, "이슈")]
    assert findings(spark, "13가지 3가지", [rule("3가지", "세 가지")]) == [(5, "3가지")]
    assert findings(spark, "접데이터적", [rule("데이터")]) == []
    assert len(findings(spark, "이슈 " * 9, rows)) == 3 and len(findings(spark, "이슈 " * 9, rows, exhaustive=True)) == 9


def test_overlaps_and_wildcards(spark):
    rows = [rule("자료 구조"), rule("구조 설계서"), rule("설계서"), rule("설계~서", check="정규식")]
    assert findings(spark, "자료 구조 설계서", rows) == [(3, "구조 설계서"), (6, "설계~서")]
    assert findings(spark, "접속면", [rule("접속")]) == [(0, "접속")]


def test_fixes(spark):
    docs = spark.createDataFrame([(1, "이슈를 봅니다. 니즈가 이슈니즈"), (2, "없음")], "doc_id long, masked string")
    rows = [rule("이슈", "문제"), rule("니즈", "요구"), rule("봅", "본")]
    got = {r.doc_id: (r.fixed, r.n_fixed) for r in scan.apply_fixes(docs, rows).collect()}
    assert got[1][0].startswith("문제를") and got[2] == ("없음", 0)
    # 값(final) for 수(none) before 를 would break the particle.
    broken = scan.apply_fixes(spark.createDataFrame([(1, "니즈를")], "doc_id long, masked string"), [rule("니즈", "값")]).first()
    assert broken.n_fixed == 0 and broken.fixed == "니즈를"


def test_scan_of_decomposed_text(spark):
    """Findings of a text in its decomposed form are those of the composed one; fixes leave it as it is."""
    import unicodedata

    text = "이슈를 봄, 대이슈 그리고 니즈가 이슈니즈"
    rows = [rule("이슈", "문제"), rule("니즈", "요구")]
    loose = unicodedata.normalize("NFD", text)
    assert loose != text and findings(spark, loose, rows) == findings(spark, text, rows) != []
    docs = spark.createDataFrame([(1, text), (2, loose)], "doc_id long, masked string")
    got = {r.doc_id: (r.fixed, r.n_fixed) for r in scan.apply_fixes(docs, rows).collect()}
    assert got[1][1] > 0 and got[2] == (loose, 0)


def test_no_text_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "이슈를 봄")], "doc_id long, masked string")
    plan = scan.lint(docs, [rule("이슈")])._jdf.queryExecution().optimizedPlan().toString()
    moved = [ln for ln in plan.split("\n") if "RepartitionByExpression" in ln or "Window" in ln or "Aggregate" in ln]
    assert moved and not any("masked" in ln for ln in moved)


def test_overlaps_equal_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for d in range(6):
        for n in range(60):
            start = rnd.randint(0, 120)
            rows.append((d, start, rnd.randint(2, 9), n, 0, rnd.random() < 0.15))
    df = spark.createDataFrame(rows, "doc_id long, start int, len int, rule_ord int, alt_ord int, wild boolean")
    want = set()
    for d in range(6):
        taken = []
        for r in sorted((r for r in rows if r[0] == d and not r[5]), key=lambda r: (-r[2], r[1], r[3])):
            if not any(t[1] < r[1] + r[2] and r[1] < t[1] + t[2] for t in taken):
                taken.append(r)
        want |= set(taken) | {r for r in rows if r[0] == d and r[5]}
    assert {tuple(r) for r in scan.resolve_overlaps(df).collect()} == want


def test_rule_diff(spark):
    a, b = [rule("가나"), rule("다라")], [rule("가나", "새 말"), rule("마바")]
    got = {(r.bad, r.change, r["columns"]) for r in rules.diff_rules(rules.rules_frame(spark, a), rules.rules_frame(spark, b)).collect()}
    assert got == {("가나", "changed", "good"), ("다라", "removed", ""), ("마바", "added", "")}


# masks


@pytest.mark.parametrize(
    ("text", "hidden"),
    [
        ("a `x> y` z <b>", ["`x> y`", "<b>"]),
        ("<a `x> y` z", ["<a `x> y`"]),
        ("한글https://a.b/c 끝", ["한글https://a.b/c"]),
        ("see src/main.py 와 파일.md를 봄", ["src/main.py", "파일.md를"]),
        ("$HOME --flag $(ls)", ["$HOME", " --flag", "$(ls)"]),
        ("ERROR: disk full\n오류: 한글", ["ERROR: disk full"]),
        ("이슈Abc 말", ["이슈Abc"]),
    ],
)
def test_masks(spark, text, hidden):
    got = one(spark, text, masks.mask)[0]
    assert len(got) == len(text)
    shown = text
    for h in hidden:
        assert h in text
        at = text.index(h)
        shown = shown[:at] + masks.MARK * len(h) + shown[at + len(h) :]
    assert got == shown


def test_merged_spans(spark):
    rows = spark.createDataFrame([([(0, 3), (3, 5), (1, 2), (4, 9)],), ([],)], "r array<struct<s:int,e:int>>")
    got = [[tuple(x) for x in r[0]] for r in rows.select(merge_spans(F.col("r"))).collect()]
    assert got == [[(0, 3), (3, 9)], []]
    assert one(spark, "abcdef", lambda c: overwrite(c, spans(matches(c, "[bd]")), "*"))[0] == "a*c*ef"


def hidden(spark, text, ext):
    got = one(spark, text, lambda c: masks.format_ranges(c, F.lit(ext)))[0]
    return sorted(text[r.s : r.e] for r in got)


@pytest.mark.parametrize(
    ("ext", "text", "want"),
    [
        ("md", "---\ntitle: 제목\ntags:\n- x\n---\n글\n\n    code\n\n    more\n글 <code>a</code>\n- item\n\n    in list", ["---\n", "title:", "tags:", "- x", "---", "    code\n\n    more", "<code>a</code>"]),
        ("md", "    first\n글\n    lazy\n\n    after lazy\n# h\n\ttab\n```", ["    first", "    after lazy", "\ttab"]),
        ("md", "- a\n\n    - b\n\n    c\n\n    d\n\n글\n\n    e", ["    d", "    e"]),
        ("md", "1. a\n\n    b\n글\n\n    c\n\n\n    d\n   e", ["    c\n\n\n    d"]),
        ("md", "---\nsummary: 첫 줄\n  이어짐\n\n  떨어짐\nenv : x\n키: y\n# c\n...\n본문", ["---\n", "summary:", "  떨어짐", "env : x", "키: y", "# c", "..."]),
        ("md", "---\n\n## 글\n---", []),
        ("md", "---\n참고: 말\n---\n", []),
        ("md", "---\ntitle: x\n그냥 글\n---\n", []),
        ("md", "글\n---\ntitle: x\n---", []),
        ("md", "", []),
        ("rst", "a::\n\n    lit\nb", ["a::\n\n    lit"]),
        ("rst", ".. code-block:: python\n   :opt:\n\n    x\n\n말:\n\n    y", []),
        ("rst", ".. code:: python\n\n    x\n\n    y\n말::\n글\n\n    z", [".. code:: python\n\n    x\n\n    y"]),
        ("adoc", "x\n----\ncode\n----\ny\n....\n....  \n----", ["....\n....  ", "----\ncode\n----"]),
        ("txt", "a::\n\n    lit\n----\n----", []),
    ],
)
def test_format_ranges(spark, ext, text, want):
    assert hidden(spark, text, ext) == sorted(want)


def test_reference_labels(spark):
    df = spark.createDataFrame([(1, "[글][Ref One] [other] [글](u)\n\n[ref  one]: http://x"), (2, "[글][ref one]")], "doc_id long, text string")
    # A definition's own label is one too.
    assert sorted((r.doc_id, r.s, r.e) for r in masks.reference_labels(df).collect()) == [(1, 3, 12), (1, 29, 39)]
    assert sorted(tuple(r) for r in one(spark, df.first().text, masks.label_ranges)[0]) == [(3, 12), (29, 39)]


@pytest.mark.parametrize("work", ["matches", "mask", "rebuild", "blocks"])
def test_near_linear(spark, work):
    """Eight times the matches, at most eight times the time and a tenth."""
    import time

    column = {
        "matches": lambda t: F.size(matches(t, "`[^`]*`")),
        "mask": lambda t: F.length(overwrite(t, merge_spans(spans(matches(t, "`[^`]*`"))), "x")),
        "rebuild": lambda t: F.length(rebuild(t, F.transform(matches(t, "x"), lambda m: F.struct(m["start"], F.length(m["hit"]).alias("len"), F.lit("yy").alias("new"))))),
        "blocks": lambda t: F.size(masks.indented_blocks(t)),
    }[work]

    def seconds(n):
        df = spark.createDataFrame([("`x` 가\n\n    b\n\n" * n,)], "t string").select(column(F.col("t")))
        df.collect()
        began = time.perf_counter()
        assert df.collect()[0][0] >= n
        return time.perf_counter() - began

    small, large = seconds(4_000), seconds(32_000)
    assert large < 8 * small * 1.1 + 1


# identifiers


def residents(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return sorted((r.line, r.col, r.matched) for r in identifiers.resident_numbers(df, **options).collect())


def test_resident_numbers(spark):
    assert residents(spark, "x\n900101-1234567 끝") == [(2, 1, "900101-1234567")]
    assert residents(spark, "901301-1234567 000229-1234567") == []
    assert residents(spark, "000229-3234567") == [(1, 1, "000229-3234567")]
    assert residents(spark, 'created_at: 9001011234567 "birth_at": 9001011234567') == [(1, 39, "9001011234567")]
    assert residents(spark, "𝒳９０0101​－1234567") == [(1, 2, "900101-1234567")]
    assert residents(spark, f"900101-1234567 {identifiers.ALLOW}") == [] and len(residents(spark, f"900101-1234567 {identifiers.ALLOW}", ignore_allow_line=True)) == 1
    assert residents(spark, None) == [] and residents(spark, "") == []


def test_redaction_leaves_nothing(spark):
    df = spark.createDataFrame([(1, "a 900101-1234567\r\nb 9001011234567 c"), (2, None), (3, "clean")], "doc_id long, text string")
    out = identifiers.redact(df)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a 900101-*******\r\nb 900101-******* c", 2: None, 3: "clean"}
    assert identifiers.resident_numbers(out).count() == 0


# formats and masking


def test_numbers_and_phones(spark):
    assert one(spark, "220-81-62517", formats.valid_business_number, formats.format_business_number)[:] == (True, "220-81-62517")
    for value, kind, shown in [("01012345678", "mobile", "010-1234-5678"), ("+82-10-1234-5678", "mobile", "010-1234-5678"), ("0212345678", "area", "02-1234-5678"), ("15881234", "shared", "1588-1234"), ("05041234567", "safe", "0504-123-4567"), ("010123", None, "010123"), (None, None, None)]:
        r = one(spark, value, formats.parse_phone, formats.format_phone)
        assert (r[0] and r[0].kind) == kind and r[1] == shown, value
    assert one(spark, "02-123-4567", formats.international)[0] == "+8221234567"


def test_addresses(spark):
    r = one(spark, "서울특별시 강남구 테헤란로 12 3층", formats.mask_address, formats.address_kind)
    assert r[0] == "서울특별시 강남구 테헤란로 12 ****" and r[1] == "road"
    assert one(spark, "어딘가", formats.mask_address)[0] == "****" and one(spark, "서울 강남구", formats.mask_address)[0] == "서울 강남구"
    assert one(spark, "서울 중구 (가(나))", formats.split_reference)[0] == ("서울 중구", "가(나)")
    assert one(spark, "서울특별시 강남구 역삼동 12", formats.address_key)[0] == one(spark, "서울 강남구  역삼동 12 (역삼)", formats.address_key)[0]
    assert one(spark, "06236", formats.valid_postal_code)[0] and not one(spark, "64000", formats.valid_postal_code)[0]


def test_records(spark):
    df = spark.createDataFrame([(("홍길동", ["a@b.co"], {"memo": "전화 010-1234-5678"}["memo"], 9001011234567), True)], "p struct<Full_Name:string,emails:array<string>,memo:string,n:bigint>, ok boolean")
    r = record_masking.mask_records(df).first()
    assert r.p.Full_Name == "홍*동" and r.p.emails == ["*@b.co"] and r.p.memo == "전화 *************" and r.p.n == "*" * 13 and r.ok is True
    assert record_masking.mask_records(spark.createDataFrame([((("a",),),)], "phone struct<x:struct<y:string>>")).first()[0] == "****"
    assert record_masking.combination_warning(spark.createDataFrame([("a", "b")], "birthDate string, zip_code string")) == ["birthDate", "zip_code"]


# calendars


def test_substitutes():
    got = workdays.with_substitutes([("2024-02-10", "설날"), ("2024-02-11", "설날"), ("2024-05-05", "어린이날"), ("2025-05-05", "어린이날"), ("2025-05-05", "부처님오신날"), ("2024-06-06", "현충일")])
    assert [(d, s) for d, _, s in got if s] == [("2024-02-12", "설"), ("2024-05-06", "어린이날"), ("2025-05-06", "어린이날, 부처님오신날")]


def test_business_days(spark):
    closed = spark.createDataFrame([("2024-01-01",)], "d string").select(F.to_date("d").alias("d"))
    days = workdays.calendar(closed, "2023-12-01", "2024-02-01")
    df = spark.createDataFrame([("2023-12-29", 1), ("2023-12-31", 1), ("2024-01-01", 0), ("2024-01-05", 2)], "day string, n int").withColumn("day", F.to_date("day"))
    got = {(str(r.day), r.n): str(r.due) for r in workdays.add_business_days(df, "day", F.col("n"), days).collect()}
    assert got == {("2023-12-29", 1): "2024-01-02", ("2023-12-31", 1): "2024-01-02", ("2024-01-01", 0): "2024-01-01", ("2024-01-05", 2): "2024-01-09"}


# reviews, links, shell, guard


def test_urls(spark):
    for raw, url in [("https://e.org/a" + ")." * 12, "https://e.org/a"), ("https://e.org/(a)b" + ").)" * 3000, "https://e.org/(a)b"), ("https://e.org/((a).).,", "https://e.org/((a).)"), ("https://a.b/c).", "https://a.b/c"), ("https://a.b/(c)", "https://a.b/(c)"), ("https://a.b/c]!?", "https://a.b/c"), ("https://a.b/c\"'", "https://a.b/c")]:
        assert one(spark, raw, review.trim_url)[0] == url
    df = spark.createDataFrame([(1, "x https://a.b/c, 그리고 https://d.e/f입니다\nhttps://a.b/c")], "d long, t string")
    got = {r.url: r.n for r in review.group_links(review.extract_links(df, "d", "t"), "d").collect()}
    assert got == {"https://a.b/c": 2, "https://d.e/f": 1}
    assert one(spark, "https://x.example.com/a", lambda c: review.excluded_url(c, "me/own", ["x.example.com"]))[0]


def test_markdown_and_csv(spark, tmp_path):
    assert one(spark, "a``b", review.code_span)[0] == "```a``b```"
    assert one(spark, "=1,2", review.escape_cell)[0] == "\"'=1,2\"" and one(spark, None, review.escape_cell)[0] == ""
    writers.write_excel_csv(spark.createDataFrame([(2, "b"), (1, "-a")], "k int, v string"), str(tmp_path / "c"), ["k"])
    body = next((tmp_path / "c").glob("part-*")).read_bytes()
    assert body == "﻿1,'-a\r\n2,b\r\n".encode()


@pytest.mark.parametrize(
    ("command", "texts"),
    [
        ("git commit -m 'one'", ["one"]),
        ('git add . && git commit -am "a \\"b\\"" -m two', ['a "b"', "two"]),
        ("git commit --message=x", ["x"]),
        ("echo 'git commit -m no'", []),
        ("bash -c 'git commit -m \"deep\"'", ["deep"]),
        ("git commit -m \"$(cat <<'EOF'\nbody\nEOF\n)\"", ["body"]),
        ("git log", []),
    ],
)
def test_commit_targets(command, texts):
    got = shell.commit_targets(command)
    assert [t for _, _, t, _, _ in got] == texts
    assert all((shell.unescape(command[s:e]) if quote == '"' else command[s:e]) == t for s, e, t, quote, ok in got if ok)


def test_guard_batch_and_stream(spark, tmp_path):
    lines = ['{"tool_name":"Write","hook_event_name":"PreToolUse","tool_input":{"file_path":"a.md","content":"900101-1234567"}}', "junk", '{"tool_name":"MultiEdit","hook_event_name":"PreToolUse","tool_input":{"file_path":"a.md","edits":[{"new_string":"x"},{"new_string":"9001011234567"}]}}', '{"tool_name":"Bash","hook_event_name":"PreToolUse","tool_input":{"command":"ls"}}']
    got = [r.decision for r in guard.decisions(guard.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()]
    assert got == ["deny", None, "deny", None]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text("\n".join(lines))
    from textsieve.streaming import guard_stream

    q = guard_stream.decision_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("g").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert sorted(str(r.decision) for r in spark.table("g").collect()) == ["None", "None", "deny", "deny"]
    assert guard.as_json(guard.decisions(guard.parsed(spark.createDataFrame([(x,) for x in lines], "value string")))).count() == 2


def test_budget_and_issues(spark):
    # By hand, 100 in all and 50 a lane: a (40 and a heading of 2), c (10 and 2); b is over its lane and at the end of
    # its priority over all; d is tried after that though it comes before c in no priority; e fits in no lane but in what is left.
    rows = [("a", "terms", "h", 40, "핵심"), ("b", "terms", "h", 80, "핵심"), ("c", "prompt", "p", 10, "핵심"), ("d", "terms", "h", 10, "보통"), ("e", "terms", "h", 30, "보통"), ("f", "prompt", "p", 6, "참고")]
    assert review.budgeted(rows, 100) == ["a", "c", "d", "e", "f"]
    # A core row that was put off goes before rows of lesser priority.
    assert review.budgeted([("a", "terms", "h", 40, "핵심"), ("b", "terms", "h", 40, "핵심"), ("c", "prompt", "p", 40, "보통")], 100) == ["a", "b"]
    df = spark.createDataFrame([(1, "### A\n\n```\nx\n```\n\n### B\n\n_No response_\n")], "k long, body string")
    assert {(r.label, r.value) for r in review.issue_fields(df, "k", "body").collect()} == {("A", "x"), ("B", "")}


def test_language(spark):
    df = spark.createDataFrame([("r", s) for s in ["고침 둘", "Merge branch", "fix it", "더함 셋", "추가 넷", "bump a from 1 to 2", ""]], "repo string, s string")
    r = stats.language_by(df, "repo", "s").first()
    assert (r.n_samples, r.language) == (4, "korean")
    assert one(spark, "글\n```\ncode code", stats.hangul_share)[0] == 1.0
    assert one(spark, "git push합니다. 이제 push합니다", lambda c: F.size(stats.latin_verbs(c)))[0] == 1


def test_sources(spark, tmp_path):
    assert readers.glob_to_regex("docs/**/*.md") == r"^docs/(?:.*/)?[^/]*\.md$"
    (tmp_path / "a.txt").write_bytes("가나".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\x00")
    got = {r.path[-5:]: r.text for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "가나", "b.txt": None}
    cut = spark.createDataFrame([(bytearray("가나".encode()),)], "c binary").select(readers.bounded_text(F.col("c"), 5)).first()[0]
    assert cut == "가"
    writers.write_rule_tables(rules.rules_frame(spark), str(tmp_path / "rules"))
    assert one(spark, "a%b\nc", lambda c: writers.annotation(F.lit("f:1"), F.lit(1), F.lit(2), c))[0] == "::warning file=f%3A1,line=1,col=2::a%25b%0Ac"


def test_findings_once_and_by_hour(spark, tmp_path):
    from textsieve.streaming import guard_stream

    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.json").write_text('{"fp":"x","ts":"2024-01-01T00:10:00Z","decision":"deny"}\n{"fp":"x","ts":"2024-01-01T00:20:00Z","decision":"warn"}\n{"fp":"y","ts":"2024-01-01T01:10:00Z","decision":"deny"}')
    rows = spark.readStream.schema("fp string, ts timestamp, decision string").json(str(tmp_path / "f"))
    for name, df, mode in (("once", guard_stream.new_findings(rows), "append"), ("hours", guard_stream.hourly_decisions(rows), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    assert sorted(r.fp for r in spark.table("once").collect()) == ["x", "y"]
    assert {(str(r.hour), r.decision, r.n) for r in spark.table("hours").collect()} == {("2024-01-01 00:00:00", "deny", 1), ("2024-01-01 00:00:00", "warn", 1), ("2024-01-01 01:00:00", "deny", 1)}


def test_reports(spark):
    from textsieve.operators import reports, triage

    docs = spark.createDataFrame([("r", "README.md", "짧음"), ("r", "CONTRIBUTING.md", "plain words " * 30), ("s", "README.md", None), ("t", "x.md", "글")], "repo string, path string, text string")
    assert dict(reports.doc_language(docs).collect()) == {"r": "english", "s": "unknown", "t": "unknown"}
    text = spark.createDataFrame([(1, "첫 줄\n이슈를 봄 900101-1234567\n이슈를 봄")], "doc_id long, masked string")
    rows = [rule("이슈", "문제")]
    found = reports.findings_by_line(text, rows)
    assert sorted((r.line, r.col, r.has_pii, r.replacement) for r in found.collect()) == [(2, 1, True, "문제"), (3, 1, False, "문제")]
    assert [tuple(r) for r in reports.line_suggestions(found).collect()] == [(1, 3, "문제를 봄")]
    assert one(spark, "a <!-- b -->x<!-- e --> c", lambda c: triage.replace_block(c, "<!-- b -->", "<!-- e -->", F.lit("new")))[0] == "a <!-- b -->new<!-- e --> c"
    assert one(spark, "1.2.3", triage.version)[0] == (1, 2, 3) and one(spark, "1.2", triage.version)[0] is None
    assert one(spark, "merged-1.md", lambda c: reports.answer_kind(c, "^none-", "^merged-"))[0] == "falsePositive"


# the whole job: what round 1 left out


def test_fixes_leave_masked_text(spark):
    from textsieve.operators import reports

    text = "이슈를 봄 `이슈` https://example.com/이슈 commit를 `server을` [글][이슈]\n\n    server을 이슈\n\n[이슈]: http://x.y"
    fixed = "문제를 봄 `이슈` https://example.com/이슈 commit을 `server을` [글][이슈]\n\n    server을 이슈\n\n[이슈]: http://x.y"
    docs = spark.createDataFrame([(1, text, "md"), (2, None, "md")], "doc_id long, text string, ext string")
    masked = masks.protected(docs, ext_col="ext")
    got = {r.doc_id: (r.fixed, r.n_fixed) for r in scan.apply_fixes(masked, [rule("이슈", "문제")], original="text").collect()}
    assert got[1] == (fixed.replace("commit을", "commit를"), 1) and got[2][1] == 0
    errors = masked.select(F.explode(particles.particle_errors(F.col("masked"), F.col("text"))).alias("e")).collect()
    assert [r.e.matched for r in errors] == ["commit를"]
    assert {r.doc_id: r.fixed for r in reports.fix_texts(docs, [rule("이슈", "문제")], ext_col="ext").collect()} == {1: fixed, 2: ""}


def test_fixed_queries_keep_code_and_links(spark):
    from textsieve.plans import catalogue
    from textsieve.plans.derived import ko_docs

    texts = {r.doc_id: r.text for r in ko_docs(spark, "/root/testdata/sf0.001").collect()}
    for name in ("fixed_docs", "fixed_texts"):
        rows = catalogue.queries()[name](spark, "/root/testdata/sf0.001").collect()
        for part in ("`이슈`", "https://example.com/이슈"):
            assert all(part in r.fixed for r in rows if part in texts[r.doc_id])
            assert any(part in r.fixed for r in rows)


@pytest.mark.parametrize(
    ("command", "texts"),
    [
        ("git commit -F - <<'EOF'\nbody one\nline\nEOF\necho x", ["body one\nline"]),
        ("git commit --file=- <<-EOF\n\tbody\n\tEOF", ["\tbody"]),
        ("cat <<A; git commit -F- <<B\nnot\nA\nyes\nB\n", ["yes"]),
        ("git commit -F notes.txt", []),
        ("git commit -mtext -am'more text'", ["text", "more text"]),
        ("(git commit -m x)", ["x"]),
        ("( cd a && git commit -m 'x y' )", ["x y"]),
        ("out=$(git commit -m 'in') && echo", ["in"]),
        ("$(git commit -m x)", ["x"]),
        ("git commit -m a -- -m b", ["a"]),
        ("git commit --message='a b'", ["a b"]),
        ("sudo -n /usr/bin/git commit -m x", ["x"]),
        ("bash -lc \"git commit -m \\\"deep\\\"\"", ["deep"]),
        ("git commit 2>&1 -asvmtext -m=x", ["text", "=x"]),
        ("git log -m commit -m x", []),
        ("git commit --amend --fixup=x", []),
    ],
)
def test_commit_targets_of_all_forms(command, texts):
    got = shell.commit_targets(command)
    assert [t for _, _, t, _, _ in got] == texts
    assert all(command[s:e] == t for s, e, t, quote, ok in got if ok and quote != '"')


# the tone of tool calls


def calls(spark, rows):
    import json

    lines = [(i, json.dumps({"tool_name": t, "hook_event_name": e, "tool_input": g}, ensure_ascii=False)) for i, (t, e, g) in enumerate(rows)]
    return guard.parsed(spark.createDataFrame(lines, "event_id long, value string")).drop("value")


def test_tone_of_calls(spark):
    from textsieve.operators import tone

    pre, post = "PreToolUse", "PostToolUse"
    rows = [
        ("Edit", pre, {"file_path": "a.md", "old_string": "옛 글", "new_string": "이슈를 봅니다"}),
        ("Edit", pre, {"file_path": "a.md", "old_string": "코드 글", "new_string": "이슈를 봅니다"}),
        ("MultiEdit", pre, {"file_path": "a.md", "edits": [{"old_string": "옛 글", "new_string": "니즈는 이슈입니다"}, {"old_string": "없음", "new_string": "이슈를 봅니다"}]}),
        ("Edit", pre, {"file_path": "off.md", "old_string": "옛 글", "new_string": "이슈를 봅니다"}),
        ("Bash", pre, {"command": 'git commit -m "이슈를 \\"봅니다\\""'}),
        ("Write", pre, {"file_path": "a.md", "content": "이슈 900101-1234567 봅니다"}),
        ("Write", post, {"file_path": "a.md", "content": "commit를 봅니다 그리고 또"}),
    ]
    files = spark.createDataFrame([("a.md", "옛 글\n`코드 글`\n"), ("off.md", f"{'<!-- textsieve:ignore-file -->'}\n옛 글")], "path string, text string")
    events = calls(spark, rows)
    fix = {r.event_id: r for r in tone.verdicts(events, "event_id", mode=tone.FIX, files=files, block_pii=False).collect()}
    assert len(fix) == len(rows) and fix[0].decision == "fix" and fix[0].updated.new_string == "문제를 봅니다"
    assert fix[1].decision is None and fix[3].decision is None, "masked places and files that say so stay"
    assert [e.new_string for e in fix[2].updated.edits] == ["요구는 문제입니다", "이슈를 봅니다"], "an edit without a place is not fixed"
    assert fix[4].updated.command == 'git commit -m "문제를 \\"봅니다\\""'
    assert fix[5].n_pii == 1 and fix[5].decision == "fix" and (fix[6].decision, fix[6].n_particles) == ("warn", 1)
    block = {r.event_id: r.decision for r in tone.verdicts(events.where("event_id in (0, 5, 6)"), "event_id", mode=tone.BLOCK).collect()}
    assert block == {0: "deny", 5: "deny", 6: "warn"}


def test_notes(spark, tmp_path):
    from textsieve.operators import notes

    links = spark.createDataFrame([(f"https://e.org/{i:03}", "dead", [("f", k) for k in range(7)]) for i in range(40)], "url string, status string, locations array<struct<file:string,line:int>>")
    body = notes.link_report(links).first().body
    assert body.startswith("# Links\n\n## dead (40)\n\n- <https://e.org/000> f:0, f:1, f:2, f:3, f:4 and 2 more\n") and body.endswith("- and 10 more\n")
    assert "alive" in notes.link_report(links.where("false")).first().body and "No link" in notes.link_report(links, outage=True).first().body
    reviews = spark.createDataFrame([(1, "me", "<!-- m --> a"), (2, "me", "b"), (3, "you", "<!-- m -->"), (4, "me", "<!-- m --> c")], "id long, author string, body string")
    assert [r.id for r in notes.reviews_to_minimize(reviews, "me", "<!-- m -->", keep=4).collect()] == [1]
    got = spark.range(1).select(notes.triage_comment(F.array(F.lit("a"), F.lit("b")), F.lit("x" * 2001), F.array().cast("array<string>")).alias("c"), notes.leak_advice(F.lit("path"), F.lit(1), F.lit(None).cast("string")).alias("l")).first()
    assert got.c == "Labels: a, b\n\n> " + "x" * 2000 + "…\n\nNothing found." and got.l.startswith("1 resident number in the file's name;")
    c = spark.createDataFrame([("r", "unknown"), ("s", "korean")], "repo string, language string")
    d = spark.createDataFrame([("r", "english"), ("t", "mixed")], "repo string, language string")
    assert dict(notes.repository_language(c, d, "repo").collect()) == {"r": "english", "s": "korean", "t": "mixed"}
    df = spark.createDataFrame([("missed-expression", 0, "이슈", ["니즈"]), ("missed-expression", 1, "이슈", ["이슈"]), ("false-positive", 1, "", ["이슈"])], "t string, n int, w string, f array<string>")
    assert [r[0] for r in df.select(notes.reproduced(F.col("t"), F.col("n"), F.col("w"), F.col("f"))).collect()] == [True, False, True]


def test_more_sources_and_sinks(spark, tmp_path):
    import json

    df = spark.createDataFrame([(2, None), (1, "가")], "k int, v string")
    for name, rows, want in (("j", df, [{"k": 1, "v": "가"}, {"k": 2, "v": None}]), ("e", df.where("false"), [])):
        writers.write_json(rows, str(tmp_path / name), ["k"])
        body = "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
        assert body.endswith("]\n") and json.loads(body) == want
    writers.write_text(df, str(tmp_path / "t"), "k", ["k"])
    assert "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*"))) == "1\n2\n"
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_bytes("이름,값\n가나,1\n다라,2\n".encode("cp949"))
    (tmp_path / "csv" / "b.csv").write_bytes(b"\xff\xff\xff")
    assert sorted(tuple(r) for r in readers.read_legacy_csv(spark, str(tmp_path / "csv"), "name string, n int").collect()) == [("가나", 1), ("다라", 2)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "s.md").write_text("가")
    (tmp_path / "w" / "l.md").write_text("나" * 50)
    assert {r.path[-4:]: r.text for r in readers.read_for_context(spark, str(tmp_path / "w"), limit=100).collect()} == {"s.md": "가", "l.md": None}
    paths = spark.createDataFrame([("a/b.md",), ("a/node_modules/b.md",), (".git/x",), ("distant/x",)], "path string")
    assert sorted(r.path for r in readers.outside(paths).collect()) == ["a/b.md", "distant/x"]
    versions = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y")], "path string, sha string, text string")
    assert [tuple(r) for r in readers.snapshot(versions, "2").collect()] == [("a", "y")]
