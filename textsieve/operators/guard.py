"""Tool-call events to decisions: what a call would write is scanned before it does.

Works alike on a batch and on a stream: a projection with no state. Personal
data denies or warns and goes before tone; malformed events give no decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hangul import looks_korean
from ..operators import rules as R
from .identifiers import ALLOW, GLUED, PATH, SEPARATED, birth_date, fold, time_key_before
from .positions import matches

SCHEMA = (
    "tool_name string, hook_event_name string, tool_input struct<command:string,file_path:string,notebook_path:string,content:string,old_string:string,"
    "new_string:string,new_source:string,replace_all:boolean,edits:array<struct<old_string:string,new_string:string,replace_all:boolean>>>"
)
# Files that are not looked into.
SKIPPED = r"(?i)\.(?:png|jpe?g|gif|webp|ico|svg|pdf|zip|gz|tar|woff2?|ttf|eot|mp[34]|mov|wasm|lock)$"
GENERATED = r"(?:^|[\\/])(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Cargo\.lock|composer\.lock|go\.sum)$"
DOCS = r"(?i)\.(?:md|mdx|markdown|txt|rst|adoc)$"


def parsed(events: DataFrame, raw: str = "value") -> DataFrame:
    """events with the event's fields; text that is no event has nulls."""
    return events.withColumn("e", F.from_json(raw, SCHEMA)).select("*", "e.*").drop("e")


def pii_targets(tool: Column, given: Column) -> Column:
    """Array of (kind, text, edit_index) that a call writes; kind path has the file's own name."""
    path = F.coalesce(F.when(given["file_path"] != "", given["file_path"]), given["notebook_path"], F.lit(""))
    target = lambda kind, text, n=F.lit(None).cast("int"): F.struct(F.lit(kind).alias("kind"), text.alias("text"), n.alias("edit_index"))
    edits = F.when(tool == "MultiEdit", F.transform(given["edits"], lambda x, i: target("edit", x["new_string"], i)))
    own = F.array(
        target("command", F.when(tool == "Bash", given["command"])),
        target("path", F.when((tool != "Bash") & (path != ""), path)),
        target("content", F.when(tool == "Write", given["content"])),
        target("edit", F.when(tool == "Edit", given["new_string"]).when(tool == "NotebookEdit", given["new_source"])),
    )
    every = F.filter(F.concat(own, F.coalesce(edits, F.array().cast("array<struct<kind:string,text:string,edit_index:int>>"))), lambda t: t["text"].isNotNull())
    return F.when((tool != "Bash") & (path.rlike(SKIPPED) | path.rlike(GENERATED)), F.filter(every, lambda t: F.lit(False))).otherwise(every)


def resident_count(text: Column, path_only: Column) -> Column:
    """Plausible resident numbers in a text, line by line."""

    def line(s):
        clean = fold(s)
        glued = F.filter(matches(clean, GLUED), lambda m: ~time_key_before(F.substring(clean, F.lit(1), m["start"])))
        found = F.when(path_only, matches(clean, PATH)).otherwise(F.concat(matches(clean, SEPARATED), glued))
        return F.size(F.filter(found, lambda m: birth_date(m["hit"]).isNotNull()))

    lines = F.filter(F.split(text, "\n", -1), lambda s: ~s.contains(ALLOW) & s.rlike(r"\p{Nd}"))
    return F.aggregate(lines, F.lit(0), lambda a, s: a + line(s))


def decisions(events: DataFrame, rules=R.RULES, *, block: bool = True) -> DataFrame:
    """events (tool_name, hook_event_name, tool_input) with n_pii, n_tone and decision.

    decision: deny, warn or null. Tone is judged after the call only, on texts in
    Korean, by the plain alternatives of scanned rules. This is a part of the tone
    job: MultiEdit edits and commit messages are not judged, nothing is masked, no
    boundary, wildcard or particle is looked at, and no fix or block comes before.
    """
    tool, given = F.col("tool_name"), F.col("tool_input")
    n_pii = F.aggregate(pii_targets(tool, given), F.lit(0), lambda a, t: a + resident_count(t["text"], t["kind"] == "path"))
    before = F.col("hook_event_name") == "PreToolUse"
    text = F.coalesce(F.when(tool == "Write", given["content"]).when(tool == "Edit", given["new_string"]), F.lit(""))
    is_doc = F.coalesce(given["file_path"], F.lit("")).rlike(DOCS) | (F.coalesce(given["file_path"], F.lit("")) == "")
    terms = [F.lit(a["alt"]) for a in R.rule_alternatives(rules) if not a["wild"]]
    n_tone = F.size(F.filter(F.array(*terms), lambda t: text.contains(t)))
    out = events.withColumn("n_pii", F.when(before, F.coalesce(n_pii, F.lit(0))).otherwise(0)).withColumn("n_tone", F.when(~before & is_doc & looks_korean(text), n_tone).otherwise(0))
    decision = F.when((F.col("n_pii") > 0) & F.lit(block), "deny").when((F.col("n_pii") > 0) | (F.col("n_tone") > 0), "warn")
    return out.withColumn("decision", F.when(tool.isNotNull() & F.col("hook_event_name").isNotNull(), decision))


def as_json(rows: DataFrame) -> DataFrame:
    """The decisions as JSON, one line each; events without one are left out."""
    body = F.struct(F.struct(F.col("hook_event_name").alias("hookEventName"), F.when(F.col("decision") == "deny", "deny").alias("permissionDecision"), F.concat(F.col("n_pii").cast("string"), F.lit(" identifiers, "), F.col("n_tone").cast("string"), F.lit(" terms")).alias("additionalContext")).alias("hookSpecificOutput"))
    return rows.where(F.col("decision").isNotNull()).select(F.to_json(body).alias("value"))
