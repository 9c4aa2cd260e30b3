"""Sinks: spreadsheet CSV, annotations, Markdown bodies, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.review import csv_lines


def write_excel_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """UTF-8 with a BOM and CRLF, one part, in order: for results that a person opens."""
    body = csv_lines(df.orderBy(*order), df.columns).coalesce(1)
    first = F.monotonically_increasing_id() == 0
    body.select(F.when(first, F.concat(F.lit("﻿"), F.col("value"))).otherwise(F.col("value")).alias("value")).write.option("lineSep", "\r\n").text(path)


def json_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """The lines (value) of one JSON array with a row a line, in order and in one part; the last line is the bracket's."""
    names = [f"o{i}" for i in range(len(order))]
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"), *[F.col(c).alias(n) for c, n in zip(order, names)])
    lines = rows.orderBy(*names).select("value").coalesce(1).select(F.concat(F.when(F.monotonically_increasing_id() == 0, F.lit("[")).otherwise(F.lit(",")), F.col("value")).alias("value"))
    last = df.agg(F.when(F.count(F.lit(1)) == 0, "[]").otherwise("]").alias("value"))
    return lines.unionByName(last).coalesce(1)


def write_json(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON array with a line break at its end: for results that a program reads whole."""
    json_lines(df, order).write.text(path)


def write_text(df: DataFrame, path: str, column: str, order: list[str]) -> None:
    """The lines of column in order, in one part, each with a line break."""
    df.orderBy(*order).select(F.col(column).cast("string").alias("value")).coalesce(1).write.text(path)


def annotation(file: Column, line: Column, col: Column, message: Column) -> Column:
    """A CI annotation; % goes first, since the others bring it in."""
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    prop = lambda c: F.replace(F.replace(plain(c), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))
    return F.concat(F.lit("::warning file="), prop(file), F.lit(",line="), line.cast("string"), F.lit(",col="), col.cast("string"), F.lit("::"), plain(message))


def write_rule_tables(rules: DataFrame, path: str) -> None:
    """One Markdown table for each source, by priority."""
    cell = lambda c: F.trim(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in ("en", "bad", "good", "why", "check", "priority")]), F.lit(" |"))
    rules.select("source", "rule_ord", row.alias("value")).repartition("source").sortWithinPartitions("source", "rule_ord").select("source", "value").write.partitionBy("source").text(path)


def grouped_list(df: DataFrame, keys: list[str], order: list[str], show: int = 20) -> DataFrame:
    """One row: the first show groups by first appearance with their counts, and how many more there are."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    top = groups.orderBy("first").limit(show).agg(F.sort_array(F.collect_list(F.struct("first", *keys, "n"))).alias("shown"))
    return top.crossJoin(groups.agg(F.greatest(F.count(F.lit(1)) - show, F.lit(0)).alias("more")))
