"""Commit messages in shell commands, with their spans: a table function over a small lexer."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

MAX_DEPTH = 3
#: Short options of git commit that can stand before m or F in one word.
SHORT = "[acCeFinoqsSuvtm]*"
FLAG = re.compile(rf"(?s)(?:(--message|--file)(?:=(.*))?|(-{SHORT}?[mF])(.+)?)")
PREFIXES = {"sudo", "time", "command", "nohup", "env", "then", "do", "else", "!"}
SHELLS = re.compile(r"(?:.*/)?(?:bash|sh|zsh|dash)")
HEREDOC = re.compile(r"<<(-?)[ \t]*(?:(['\"])(.+?)\2|([A-Za-z0-9_]+))", re.S)
CAT = re.compile(r"\$\(\s*cat\s+<<-?\s*(['\"]?)(\w+)\1\r?\n(.*?)\r?\n[ \t]*\2\s*\)", re.S)
EXPANSION = re.compile(r"\$\(|\$\{|`")


def _quoted(s: str, i: int) -> int:
    """The place of the quote that closes a double-quoted string whose text begins at i."""
    while i < len(s) and s[i] != '"':
        i = _close(s, i + 2) + 1 if s.startswith("$(", i) else i + (2 if s[i] == "\\" else 1)
    return min(i, len(s))


def _opaque(s: str, i: int) -> int | None:
    """The place after the escape, string or $(...) at i; null where there is none."""
    if s[i] == "\\":
        return min(i + 2, len(s))
    if s[i] == "'":
        end = s.find("'", i + 1)
        return len(s) if end < 0 else end + 1
    if s[i] == '"':
        return min(_quoted(s, i + 1) + 1, len(s))
    return min(_close(s, i + 2) + 1, len(s)) if s.startswith("$(", i) else None


def _close(s: str, i: int) -> int:
    """The place of the parenthesis that closes the command whose text begins at i."""
    depth, waiting = 0, []
    while i < len(s):
        after = _opaque(s, i)
        doc = None if after else HEREDOC.match(s, i)
        if after or doc:
            waiting += [doc] if doc else []
            i = after or doc.end()
        elif s[i] == "\n" and waiting:
            i, waiting = _bodies(s, i + 1, waiting)[1], []
        elif s[i] == ")" and not depth:
            return i
        else:
            depth += (s[i] == "(") - (s[i] == ")")
            i += 1
    return len(s)


def _bodies(s: str, i: int, docs: list[re.Match]) -> tuple[list[tuple[int, int, bool]], int]:
    """(start, end, quoted) of the bodies of here-documents from i on, and the place after the last."""
    out = []
    for doc in docs:
        end = re.compile(rf"(?m)^{chr(92) + 't*' if doc[1] else ''}{re.escape(doc[3] or doc[4])}$").search(s, i)
        stop = max(i, end.start() - 1) if end else len(s)
        out.append((i, stop, bool(doc[2])))
        i = min(len(s), end.end() + 1) if end else len(s)
    return out, i


def commands(s: str) -> Iterator[tuple[list[tuple[int, int]], list[tuple[int, int, bool]], list[tuple[int, int]]]]:
    """Simple commands: spans of words, here-documents, and spans within $(...) outside strings."""
    words: list[tuple[int, int]] = []
    docs: list[tuple[int, int, bool]] = []
    subs: list[tuple[int, int]] = []
    done, waiting, i, start = [], [], 0, -1
    while i <= len(s):
        c = s[i] if i < len(s) else "\n"
        # The & of 2>&1 and &> ends no command.
        ends = c in ";|()\n" or (c == "&" and s[max(0, i - 1) : i] not in ("<", ">") and s[i + 1 : i + 2] != ">")
        cut = ends or c.isspace() or s.startswith("\\\n", i)
        doc = HEREDOC.match(s, i)
        if (cut or doc) and start >= 0:
            words.append((start, i))
            start = -1
        if s.startswith("\\\n", i):
            i += 2
        elif doc:
            waiting.append((doc, docs))
            i = doc.end()
        elif ends:
            if words or docs:
                done.append((words, docs, subs))
                words, docs, subs = [], [], []
            if c == "\n" and waiting:
                bodies, i = _bodies(s, i + 1, [d for d, _ in waiting])
                for (_, own), body in zip(waiting, bodies):
                    own.append(body)
                waiting = []
                if i >= len(s):
                    break
            else:
                i += 1
        elif cut:
            i += 1
        else:
            start = i if start < 0 else start
            after = _opaque(s, i)
            if s.startswith("$(", i):
                subs.append((i + 2, _close(s, i + 2)))
            i = after or i + 1
    yield from done


def unescape(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text) and text[i + 1] in '"\\$`\n':
            out += "" if text[i + 1] == "\n" else text[i + 1]
            i += 2
        else:
            out += text[i]
            i += 1
    return out


def escape(text: str) -> str:
    return "".join("\\" + c if c in '"\\$`' else c for c in text)


def _git_commit(texts: list[str]) -> int | None:
    """The place of commit in git [options] commit, after what may stand before git."""
    k, skipped = 0, False
    while k < len(texts) and (re.match(r"[A-Za-z_]\w*=", texts[k]) or texts[k] in PREFIXES or texts[k] == "{" or (skipped and texts[k].startswith("-"))):
        skipped |= texts[k] in PREFIXES
        k += 1
    if k == len(texts) or not re.fullmatch(r"(?:.*/)?git", texts[k]):
        return None
    k += 1
    while k < len(texts) and texts[k].startswith("-"):
        k += 2 if texts[k] in ("-C", "-c") else 1
    return k if texts[k : k + 1] == ["commit"] else None


def _value(s: str, a: int, b: int, docs: list[tuple[int, int, bool]], file: bool) -> tuple[int, int, str, str, bool] | None:
    """The message that the word at a..b is, or that is read from standard input."""
    if file:
        if s[a:b].strip("'\"") not in ("-", "/dev/stdin") or not docs or docs[-1][0] >= docs[-1][1]:
            return None
        a, b, quoted = docs[-1]
        return a, b, s[a:b], "heredoc", quoted or not EXPANSION.search(s[a:b])
    quote = s[a] if s[a : a + 1] in ("'", '"') and _opaque(s, a) == b else ""
    if quote:
        a, b = a + 1, b - (b - a > 1 and s[b - 1] == quote)
    raw = s[a:b]
    if not raw.strip():
        return None
    cat = CAT.fullmatch(raw) if quote == '"' else None
    if cat:
        return a + cat.start(3), a + cat.end(3), cat[3], "heredoc", bool(cat[1]) or not EXPANSION.search(cat[3])
    if quote != '"':
        return a, b, raw, quote, bool(quote) or not re.search(r"[\\'\"$`]", raw)
    text = unescape(raw)
    return a, b, text, quote, not EXPANSION.search(raw) if text == raw else escape(text) == raw


def commit_targets(command: str, depth: int = 0, base: int = 0) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, text, quote, replaceable) of each message of git commit."""
    out: list[tuple[int, int, str, str, bool]] = []
    if depth >= MAX_DEPTH or "git" not in command or "commit" not in command:
        return out
    for words, docs, subs in commands(command):
        texts = [command[a:b] for a, b in words]
        k = _git_commit(texts)
        while k is not None and k + 1 < len(words) and texts[k + 1] != "--":
            k += 1
            flag = FLAG.fullmatch(texts[k])
            if not flag:
                continue
            a, b = words[k]
            name, glued = flag[1] or flag[3], flag[2] if flag[1] else flag[4]
            if glued is not None:
                a = b - len(glued)
            elif k + 1 < len(words):
                k += 1
                a, b = words[k]
            else:
                continue
            found = _value(command, a, b, docs, name == "--file" or name.endswith("F"))
            if found:
                out.append((base + found[0], base + found[1], *found[2:]))
        if texts and SHELLS.fullmatch(texts[0]):
            k = 1
            while k < len(texts) and re.fullmatch(r"-[A-Za-z]+", texts[k]) and "c" not in texts[k]:
                k += 1
            if k + 1 < len(texts) and re.fullmatch(r"-[A-Za-z]+", texts[k]) and texts[k + 1][0] in "'\"":
                out += _script(command, *words[k + 1], depth, base)
        for a, b in subs:
            out += commit_targets(command[a:b], depth + 1, base + a)
    return out


def _script(command: str, a: int, b: int, depth: int, base: int) -> list[tuple[int, int, str, str, bool]]:
    """Targets within the quoted script of bash -c; places are those of the escaped text."""
    raw = command[a + 1 : b - 1]
    if command[a] == "'":
        return commit_targets(raw, depth + 1, base + a + 1)
    at, i = [0], 0
    while i < len(raw):
        i += 2 if raw[i] == "\\" and raw[i + 1 : i + 2] and raw[i + 1] in '"\\$`\n' else 1
        at += [i] * (0 if raw[i - 2 : i] == "\\\n" else 1)
    out = []
    for s, e, text, quote, ok in commit_targets(unescape(raw), depth + 1):
        same = raw[at[s] : at[e]]
        out.append((base + a + 1 + at[s], base + a + 1 + at[e], text, quote, ok and same == text and "$" not in same and "`" not in same))
    return out


def commit_messages(df: DataFrame, key: str, command: str) -> DataFrame:
    """Rows (key, start, end, text, quote, replaceable). Commands without both words never reach Python."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [(k, *t) for k, c in zip(b[key], b[command]) for t in commit_targets(c)]
            yield pd.DataFrame(rows, columns=[key, "start", "end", "text", "quote", "replaceable"])

    ship(df.sparkSession)
    rows = df.where(F.col(command).contains("git") & F.col(command).contains("commit")).select(key, command)
    return rows.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, start long, end long, text string, quote string, replaceable boolean")
