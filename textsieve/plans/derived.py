"""Derived inputs: SQL expressions that Spark and DuckDB read alike.

The given tables have no Hangul, so Korean inputs are made from keys. No
backslash and no function with differing names may stand in these strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Invented sentences; each template has something for some operator.
BODIES = [
    "레버리지와 문장을 통하여 이슈를 되어지다 말고 고칩니다. commit를 올리고 API은 그대로 둡니다.",
    "몇일 안에 컨텐츠를 3가지 고르고 이슈가 있으면 알립니다. 13가지는 많습니다. server을 봅니다.",
    "니즈는 분명합니다. 대이슈는 아니고 이슈리더도 아닙니다. token가 만료되면 push합니다.",
    "The build is green and nothing is wrong here. ERROR: disk full",
    "문제를 해결하려면 가져가야 할 것이 많습니다. 이슈로는 이슈로써 이슈로봇 이야기입니다.",
    "git push합니다. 이제 push합니다. 서버(server)은 예쁩니다. 3을 더하고 7를 뺍니다.",
    "이슈 이슈 이슈 이슈 이슈가 이어집니다. 얼라인먼트가 필요합니다.",
]
TAILS = ["", " `이슈` 코드와 <b>이슈</b> 태그", " https://example.com/이슈 주소", " 순위 이슈적 접근", " 데이터베이스 이야기"]
IGNORE = "<!-- textsieve:ignore-file -->"


def case(key: str, values: list[str]) -> str:
    """A CASE over key % len(values)."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


KO_TEXT = f"({case('doc_id', BODIES)} || {case('(doc_id % 35)', TAILS)} || CASE WHEN doc_id % 17 = 0 THEN chr(10) || '{IGNORE}' ELSE '' END)"
KO_SQL = f"SELECT doc_id, source, {KO_TEXT} AS text FROM documents"

RRN_FRONT = "(substring(cast(o_orderdate AS varchar(30)), 3, 2) || lpad(cast(1 + o_orderkey % 13 AS varchar(9)), 2, '0') || lpad(cast(1 + o_orderkey % 33 AS varchar(9)), 2, '0'))"
RRN_BACK = "(cast(1 + o_orderkey % 8 AS varchar(9)) || lpad(cast(o_orderkey % 1000000 AS varchar(9)), 6, '0'))"
RRN_TEXT = f"(CASE o_orderkey % 5 WHEN 0 THEN '번호 ' WHEN 1 THEN 'created_at: ' WHEN 2 THEN 'birth=' WHEN 3 THEN 'x' ELSE '' END || {RRN_FRONT} || CASE o_orderkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '' ELSE ' ' END || {RRN_BACK} || CASE o_orderkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '.' ELSE '' END)"
RRN_SQL = f"SELECT o_orderkey AS id, {RRN_FRONT} AS front, {RRN_BACK} AS back, {RRN_TEXT} AS text FROM orders"

BIZ_SQL = "SELECT c_custkey AS id, lpad(cast((c_custkey * 7919 + 1234567) % 10000000000 AS varchar(12)), 10, '0') AS value, lpad(cast((c_custkey * 104729 + 987654321) % 1000000000000 AS varchar(14)), 13, '1') AS corp FROM customer"
PREFIXES = ["010", "02", "031", "15", "070", "0504", "8210", "099", "016", "008210", "064", "18"]
PHONE_SQL = f"SELECT s_suppkey AS id, ({case('s_suppkey', PREFIXES)} || CASE WHEN s_suppkey % 5 = 0 THEN '-' ELSE '' END || lpad(cast((s_suppkey * 7907) % 100000000 AS varchar(9)), CASE WHEN s_suppkey % 2 = 0 THEN 8 ELSE 7 END, '0') || CASE WHEN s_suppkey % 19 = 0 THEN '9' ELSE '' END) AS value FROM supplier"
REGIONS = ["서울특별시", "서울", "부산시", "경기도", "충북", "제주특별자치도", "하늘나라", "세종시"]
DISTRICTS = [" 강남구", " 중구", " 수원시 영통구", "", " 청주시"]
DETAILS = [" 테헤란로 12", " 역삼동 123-4", " 세종대로 지하 3", " 산골길 7-1 (역삼동)", " 아무 데나", " 봉명동 산 5 3층"]
ADDRESS_SQL = f"SELECT c_custkey AS id, ({case('c_custkey', REGIONS)} || {case('(c_custkey % 40)', DISTRICTS)} || {case('(c_custkey % 48)', DETAILS)}) AS value FROM customer"
NAME_SQL = f"SELECT c_custkey AS id, {case('c_custkey', ['김', '이순', '박지민', '남궁민수', '', 'Ann Lee'])} AS name, ({case('c_custkey', ['a', 'ab', 'abc', 'user.name', ''])} || '@mail' || cast(c_custkey % 10 AS varchar(2)) || '.example.com') AS email, (cast(1000 + c_custkey AS varchar(12)) || '-' || cast(c_custkey * 37 AS varchar(12))) AS account FROM customer"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the statements above, over the tables of a folder."""
    table = sql.rsplit(" FROM ", 1)[1].split()[0]
    items, _ = sql[len("SELECT ") :].rsplit(" FROM ", 1)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.selectExpr(*_split(items))


def _split(items: str) -> list[str]:
    """Select items, split at commas outside quotes and parentheses."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(items):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                out.append(items[start:i])
                start = i + 1
    return [*out, items[start:]]


def ko_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, KO_SQL)


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ko_docs with ext: they are read as Markdown."""
    return ko_docs(spark, sf_dir).withColumn("ext", F.lit("md"))


#: Texts put together to a longer one.
TOGETHER = 50
LONG_SQL = f"SELECT doc_id // {TOGETHER} AS doc_id, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM ({KO_SQL}) WHERE NOT contains(text, '{IGNORE}') GROUP BY 1"


def long_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ko_docs, TOGETHER neighbours a document: many findings in one, over many lines."""
    rows = ko_docs(spark, sf_dir).where(~F.contains("text", F.lit(IGNORE)))
    per = rows.groupBy(F.floor(F.col("doc_id") / TOGETHER).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("n"), "text"))).alias("parts"))
    return per.select("doc_id", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c):
    return c.cast("long")


def count(name: str = "n"):
    return F.count(F.lit(1)).alias(name)
