"""The tone of what a tool call writes: its texts as rows, findings on them, and what to do about the call.

Texts of a call are rows of their own, so that masks, the rule scan and particles
are those of any document; verdicts are sums by call. Unlike guard.decisions this
joins, so it is for batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import particles
from ..functions.hangul import looks_korean
from . import guard, masks, reports, rules, scan, shell, triage
from .positions import rebuild

#: Characters of a call's texts, together, that are fixed at most.
MAX_FIXED = 2_000_000
# Text files that hold no prose, by name.
EXEMPT = r"^(?:CMakeLists\.txt|requirements.*\.txt|.*-requirements\.txt|constraints.*\.txt|robots\.txt)$"
WARN, BLOCK, FIX = "warn", "block", "fix"


def targets(events: DataFrame, key: str, files: DataFrame | None = None) -> DataFrame:
    """Rows (key, n, field, text, ext, start, end, quote, safe): the Korean texts that a call writes.

    Commit messages of shell commands, contents of documents, new parts of edits. files
    (path, text): what stands there already; an edit in a masked place of its file is
    left out, one that can't be placed isn't safe to fix, and a file that says so is
    not looked into. Without files no edit is safe to fix.
    """
    given, tool = F.col("tool_input"), F.col("tool_name")
    path = F.coalesce(given["file_path"], F.lit(""))
    name, ext = F.regexp_extract(path, r"([^/\\]*)$", 1), F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    none = lambda kind: F.lit(None).cast(kind)
    docs = events.where((tool != "Bash") & ((path == "") | (path.rlike(guard.DOCS) & ~name.rlike(EXEMPT))))
    one = lambda n, field, old, new, many: F.struct(n.alias("n"), F.lit(field).alias("field"), old.alias("old"), new.alias("text"), F.coalesce(many, F.lit(False)).alias("many"))
    texts = (
        F.when(tool == "Write", F.array(one(F.lit(0), "content", none("string"), given["content"], F.lit(False))))
        .when(tool == "Edit", F.array(one(F.lit(0), "new_string", given["old_string"], given["new_string"], given["replace_all"])))
        .when(tool == "MultiEdit", F.transform(given["edits"], lambda e, i: one(i, "edits", e["old_string"], e["new_string"], e["replace_all"])))
    )
    rows = docs.select(F.col(key).alias("key"), path.alias("path"), ext.alias("ext"), F.explode(texts).alias("t")).select("key", "path", "ext", "t.*")
    rows = rows.where(F.col("text").isNotNull())
    rows = _placed(rows, files).select("key", "n", "field", "text", "ext", none("int").alias("start"), none("int").alias("end"), none("string").alias("quote"), "safe")
    said = shell.commit_messages(events.where(tool == "Bash").select(F.col(key).alias("key"), given["command"].alias("command")), "key", "command")
    said = said.select("key", F.col("start").cast("int").alias("n"), F.lit("command").alias("field"), "text", F.lit("").alias("ext"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "quote", F.col("replaceable").alias("safe"))
    return rows.unionByName(said).where(looks_korean(F.col("text")))


def _placed(rows: DataFrame, files: DataFrame | None) -> DataFrame:
    """rows with safe, by the files that they change; those in masked places go."""
    if files is None:
        return rows.withColumn("safe", F.col("field") == "content")
    known = masks.protected(files.select(F.col("path").alias("__path"), F.col("text").alias("__file"), F.regexp_extract("path", r"\.([^./\\]+)$", 1).alias("__ext")), "__file", "__ext", "__masked")
    rows = rows.join(known, F.col("path") == F.col("__path"), "left").where(~F.coalesce(F.col("__file").rlike(masks.IGNORE_FILE), F.lit(False)))
    n = lambda part: F.when(F.coalesce(F.length(part), F.lit(0)) > 0, F.size(triage.matches_literal(F.col("__file"), part))).otherwise(0)
    # What stands there before the call, or after it; a place that is one of several is none.
    where = lambda part: F.when((n(part) == 0) | ((n(part) > 1) & ~F.col("many")), "unknown").otherwise(triage.edit_context(F.col("__file"), F.col("__masked"), part, masks.MARK))
    context = F.when(F.col("__file").isNull(), "unknown").otherwise(F.when(where(F.col("old")) != "unknown", where(F.col("old"))).otherwise(where(F.col("text"))))
    rows = rows.withColumn("__where", F.when(F.col("field") == "content", "ok").otherwise(context)).where(F.col("__where") != "exempt")
    return rows.withColumn("safe", F.col("__where") == "ok")


def _named(rows: DataFrame) -> DataFrame:
    """rows with target, a name for text and format: calls that are tried again write the same, and it is looked at once."""
    return rows.withColumn("target", F.sha2(F.concat_ws("\x00", "ext", "text"), 256))


def _once(rows: DataFrame) -> DataFrame:
    return rows.select("target", "text", "ext").dropDuplicates(["target"])


def judged(rows: DataFrame, of=rules.RULES) -> DataFrame:
    """Rows (key, n_findings, n_particles) of the calls with either."""
    rows = _named(rows)
    texts = masks.protected(_once(rows.where(~F.col("text").rlike(masks.IGNORE_FILE))), "text", "ext")
    found = scan.lint(texts, of, doc="target").groupBy("target").agg(F.count(F.lit(1)).alias("f"))
    wrong = particles.with_errors(texts, "masked", "text", "p").select("target", F.size("p").alias("p"))
    counts = wrong.join(found, "target", "left").select("target", F.coalesce("f", F.lit(0)).alias("f"), "p").where("f + p > 0")
    return rows.select("key", "target").join(counts, "target").groupBy("key").agg(F.sum("f").alias("n_findings"), F.sum("p").alias("n_particles"))


def fixed_inputs(events: DataFrame, rows: DataFrame, key: str, of=rules.RULES, limit: int = MAX_FIXED) -> DataFrame:
    """Rows (key, updated, n_changed): the input of each call whose texts can be fixed, with the fixed ones in their places."""
    rows = _named(rows)
    sizes = rows.groupBy("key").agg(F.sum(F.length("text")).alias("__size")).where(F.col("__size") <= limit).select("key")
    rows = rows.where("safe").join(sizes, "key", "left_semi")
    new = reports.fix_texts(_once(rows), of, doc="target", ext_col="ext").where(F.col("fixed") != F.col("text")).select("target", "fixed")
    fixed = rows.join(new, "target")
    # In double quotes what was escaped is escaped again.
    shown = F.when((F.col("quote") == '"') & (F.col("end") - F.col("start") != F.length("text")), F.regexp_replace("fixed", r'([\\"$`])', r"\\$1")).otherwise(F.col("fixed"))
    per = fixed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_changed"),
        F.array_sort(F.collect_list(F.when(F.col("field") == "command", F.struct("start", (F.col("end") - F.col("start")).alias("len"), shown.alias("new"))))).alias("cuts"),
        F.map_from_entries(F.collect_list(F.when(F.col("field") != "command", F.struct("n", "fixed")))).alias("texts"),
    )
    given, tool = F.col("tool_input"), F.col("tool_name")
    at = lambda i: F.try_element_at("texts", i)
    edits = F.transform(given["edits"], lambda e, i: e.withField("new_string", F.coalesce(at(i), e["new_string"])))
    updated = (
        F.when(tool == "Bash", given.withField("command", rebuild(given["command"], F.col("cuts"))))
        .when(tool == "Write", given.withField("content", at(F.lit(0))))
        .when(tool == "Edit", given.withField("new_string", at(F.lit(0))))
        .otherwise(given.withField("edits", edits))
    )
    return events.withColumnRenamed(key, "key").join(per, "key").select("key", updated.alias("updated"), "n_changed")


def verdicts(events: DataFrame, key: str, of=rules.RULES, *, mode: str = WARN, files: DataFrame | None = None, block_pii: bool = True) -> DataFrame:
    """events with n_pii, n_findings, n_particles, updated and decision, one row for each.

    Before a call personal data comes first: it denies, or warns beside what tone
    says. With mode block findings deny, with mode fix the input is changed and no
    decision is taken by that; with mode warn nothing is said before a call. After
    a call findings and particles warn. Events without a tool or an event name get
    no decision.
    """
    base = guard.decisions(events, [], block=block_pii).drop("n_tone", "decision")
    before = F.col("hook_event_name") == "PreToolUse"
    asked = base.where(F.col("tool_name").isNotNull() & (~before if mode == WARN else F.col("hook_event_name").isNotNull()) & ~((F.col("n_pii") > 0) & F.lit(block_pii)))
    # With fixes, what is found before a call is fixed and not told.
    told = asked.where(~before) if mode == FIX else asked
    found = judged(targets(told, key, files), of).withColumnRenamed("key", "__key")
    out = base.join(found, F.col(key) == F.col("__key"), "left").drop("__key")
    if mode == FIX:
        ready = asked.where(before)
        fixes = fixed_inputs(ready, targets(ready, key, files), key, of).select(F.col("key").alias("__key"), "updated")
        out = out.join(fixes, F.col(key) == F.col("__key"), "left").drop("__key")
    else:
        out = out.withColumn("updated", F.lit(None).cast(events.schema["tool_input"].dataType))
    n = F.coalesce("n_findings", F.lit(0))
    said = n + F.coalesce("n_particles", F.lit(0)) > 0
    decision = (
        F.when((F.col("n_pii") > 0) & F.lit(block_pii), "deny")
        .when(before & F.lit(mode == BLOCK) & (n > 0), "deny")
        .when(before & F.col("updated").isNotNull(), "fix")
        .when((F.col("n_pii") > 0) | (~before & said), "warn")
    )
    named = F.col("tool_name").isNotNull() & F.col("hook_event_name").isNotNull()
    return out.withColumns({"n_findings": n, "n_particles": F.coalesce("n_particles", F.lit(0)), "decision": F.when(named, decision)})
