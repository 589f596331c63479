"""Parsers whose grammar is sequential or recursive, as Arrow-batched pandas functions."""

from __future__ import annotations

import ast
import json
import re
from typing import Any

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from . import loose
from .actions import HERE_DOCUMENT, words_of
from .text import FILE_ENDINGS, GENERIC_NAMES
from .udf import vectorized

#: Tags and the judged dimensions.
RESPONSE_TAG, JUDGE_TAG = "predicted_observation", "evaluation"
DIMENSIONS = ("format", "factuality", "consistency", "realism", "quality")


def _dump(x: Any) -> str:
    return json.dumps(x, ensure_ascii=False, default=str)


def _load(text: str | None) -> tuple[bool, Any]:
    try:
        return True, json.loads(text or "")
    except ValueError:
        return False, None


def clipped(x: Any, n: int) -> Any:
    if isinstance(x, dict):
        return {k: clipped(v, n) for k, v in x.items()}
    if isinstance(x, list):
        return [clipped(v, n) for v in x]
    if isinstance(x, str) and len(x) > n:
        return f"{x[: n // 2]}\n...[{len(x) - n} characters omitted]...\n{x[len(x) - (n - n // 2) :]}"
    return x


def clip_leaves(n: int):
    """A function that clips every string leaf of a JSON text."""

    @vectorized("string")
    def clip(text: pd.Series) -> pd.Series:
        return text.map(lambda t: _dump(clipped(x, n)) if t is not None and (y := _load(t))[0] and (x := y[1]) is not None else t)

    return clip


#: Metadata that repeats the content or carries the agent's own comments.
UNSEEN_METADATA = ("raw_action", "agent_message", "raw_timestamp")


def event_view(events: DataFrame, limit: int) -> DataFrame:
    """events (event_id, actor, kind, content, ts, metadata MAP): what an extractor sees of each. Of an action's object
    the raw copy goes, strings are clipped to limit characters (0: not at all), metadata that is no evidence goes.
    clipped: was anything?"""

    @vectorized("content string, clipped boolean")
    def seen(content: pd.Series) -> pd.DataFrame:
        out = []
        for t in content:
            ok, x = _load(t)
            if ok and isinstance(x, dict | list):
                if isinstance(x, dict) and {"raw", "arguments"} <= x.keys():
                    del x["raw"]
                short = clipped(x, limit) if limit else x
                out.append((_dump(short), short != x))
            else:
                short = clipped(t, limit) if limit else t
                out.append((short, short != t))
        return pd.DataFrame(out, columns=["content", "clipped"])

    x = events.withColumn("_v", seen(F.col("content")))
    plain = F.map_filter("metadata", lambda k, _: ~k.isin(*UNSEEN_METADATA))
    return x.select("event_id", "actor", "kind", F.col("_v.content").alias("content"), "ts", plain.alias("metadata"), F.col("_v.clipped").alias("clipped"))


def without_thinking(text: str, tag: str) -> str:
    """Paired think tags go with what they hold (an opening one takes the next free closing one), a closing tag alone
    takes all before it, an opening one alone all up to the response tag or the end."""
    marks = [(m.start(), m.end(), m[0][1] != "/") for m in re.finditer(r"</?think>", text or "", re.I)]
    if not marks:
        return text or ""
    spans, free = [], [m for m in marks if not m[2]]
    for start, _, opening in marks:
        if opening:
            close = next((m for m in free if m[0] > start), None)
            if close:
                free.remove(close)
                spans.append((start, close[1]))
            else:
                answer = re.search(rf"<{re.escape(tag)}>", text[start:], re.I) if tag else None
                spans.append((start, start + answer.start() if answer else len(text)))
    spans += [(0, m[1]) for m in free]
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at : max(at, a)])
        at = max(at, b)
    return ("".join(out) + text[at:]).strip()


def tagged(text: str, tag: str) -> str | None:
    """The last block of a tag; an open one runs to the end."""
    begin = None
    for m in re.finditer(rf"<{re.escape(tag)}>", text, re.I):
        begin = m.end()
    if begin is None:
        return None
    end = re.search(rf"</{re.escape(tag)}>", text[begin:], re.I)
    return text[begin : begin + end.start() if end else None].strip()


def model_output(text: str | None, tag: str = RESPONSE_TAG) -> str:
    if not text:
        return "No output"
    plain = without_thinking(text, tag)
    block = tagged(plain, tag)
    return (plain.strip() or "No output") if block is None else block


@vectorized("string")
def parse_model_output(text: pd.Series) -> pd.Series:
    return text.map(model_output)


def strip_thinking(tag: str):
    @vectorized("string")
    def strip(text: pd.Series) -> pd.Series:
        return text.map(lambda x: without_thinking(x or "", tag))

    return strip


def last_tagged_block(tag: str):
    @vectorized("string")
    def last(text: pd.Series) -> pd.Series:
        return text.map(lambda x: tagged(x or "", tag))

    return last


def _grade(x: Any) -> int:
    """Whole numbers, also before a slash in texts; 1 to 5, or not above 0."""
    number = re.fullmatch(r"\s*([+-]?\d+)\s*(?:/.*)?", x, re.S) if isinstance(x, str) else None
    x = int(number[1]) if number else round(x) if isinstance(x, int | float) and not isinstance(x, bool) and abs(x) < 1e9 else 0
    return min(5, x)


def judgement(text: str | None) -> dict:
    """Grades of a judge's answer, or the error that keeps them from being read. Of several objects the last with scores
    counts, of fenced ones before others; of an object that is not clean only its scores are taken."""
    out = dict(success=False, total=0.0, strengths=[], weaknesses=[], error=None, **dict.fromkeys(DIMENSIONS, 0))
    plain = without_thinking((text or "").strip(), JUDGE_TAG)
    if not plain:
        return out | {"error": "empty output"}
    target = tagged(plain, JUDGE_TAG) or plain
    fenced = [x.strip().removeprefix("json").strip() for x in target.split("```")[1:-1:2]]
    found = [loose.read_object(x, 0, open_ended=True) for x in fenced if x[:1] + x[-1:] == "{}"] or list(loose.objects(target))
    if not found:
        return out | {"error": "no JSON object"}
    best = next((x for x in reversed(found) if "scores" in x.value), found[-1])
    scores = best.value.get("scores")
    clean = best.clean(best.value)
    if not isinstance(scores, dict) or not best.clean(scores):
        return out | {"error": "no scores" if clean else "invalid JSON"}
    grades = {d: _grade(scores.get(d, 0)) for d in DIMENSIONS}
    good = [g for g in grades.values() if g > 0]
    remarks = {k: v for k in ("strengths", "weaknesses") if clean and (v := best.value.get(k)) and isinstance(v, list | str)}
    return out | {"success": True, "total": sum(good) / max(1, len(good))} | {k: [v] if isinstance(v, str) else list(map(str, v)) for k, v in remarks.items()} | grades


@vectorized("success boolean, total double, strengths array<string>, weaknesses array<string>, error string, " + ", ".join(f"{d} int" for d in DIMENSIONS))
def parse_judge_output(text: pd.Series) -> pd.DataFrame:
    out = [judgement(x) for x in text]
    return pd.DataFrame(out, columns=["success", "total", "strengths", "weaknesses", "error", *DIMENSIONS])


class UNPARSED:
    """Stands for a text that is no value; a class, so that it stays the same object in every worker."""


def unfenced(text: str) -> str:
    """What stands between a first line of three backticks, with a language or none, and backticks at the end."""
    text = text.strip()
    first, line, rest = text.partition("\n")
    language = first.rstrip().removeprefix("```")
    inside = line and first.startswith("```") and rest.endswith("```") and (not language or language.isascii() and language.isalpha())
    return rest[:-3].strip() if inside else text


def observed(text: str) -> Any:
    """The Python literal or JSON value that a text denotes, else UNPARSED."""
    text = unfenced(text or "")
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        ok, x = _load(text)
        return x if ok else UNPARSED


@vectorized("parsed boolean, value string")
def parse_observation(text: pd.Series) -> pd.DataFrame:
    out = [observed(x) for x in text]
    return pd.DataFrame({"parsed": [x is not UNPARSED for x in out], "value": [None if x is UNPARSED else json.dumps(x, sort_keys=True, ensure_ascii=False, default=lambda v: sorted(map(str, v)) if isinstance(v, set) else str(v)) for x in out]})


#: Generated ids, and what counts as a reading of a clock, in texts and as a number.
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
CLOCK = re.compile(r"\d{4}-\d{2}-\d{2}T[\d:.]+|\b1[6-9]\d{8}(?:\.\d+)?\b")
CLOCK_FROM = 1.6e9
_STRING = re.compile(r'"(?:\\.|[^"\\])*"')


def _neutral(text: str) -> str:
    return CLOCK.sub("<clock>", UUID.sub("<uuid>", text))


def _line(x: Any) -> str:
    return json.dumps(x, sort_keys=True, default=str)


def _members(pairs: list[tuple[str, Any]]) -> list[tuple[str, str]]:
    return sorted((k, _line(_settled(v))) for k, v in dict(pairs).items())


def _settled(x: Any) -> Any:
    """Lists of scalars in order; members are settled already."""
    if not isinstance(x, list):
        return x
    nested = any(isinstance(v, list | tuple) for v in x)
    return [_settled(v) for v in x] if nested else sorted(x, key=_line)


def canonical(text: str) -> Any:
    """The value of a JSON text, neutral towards what is generated: ids and clock values masked inside its strings before
    it is read, numbers of a clock while it is read, objects as members in order, lists of scalars as bags. A text that
    is no JSON is masked."""
    try:
        number = lambda of: lambda t: "<clock>" if of(t) > CLOCK_FROM else of(t)
        x = json.loads(_STRING.sub(lambda m: _neutral(m[0]), text), parse_int=number(int), parse_float=number(float), object_pairs_hook=_members)
    except ValueError:
        x = None
    return _neutral(text) if x is None else _settled(x)


@vectorized("string")
def canonical_value(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else json.dumps(canonical(t), sort_keys=True, ensure_ascii=False))


def _scalars(x: Any) -> set[str]:
    """The texts of all values inside a value that are neither null nor empty."""
    out, todo = set(), [x]
    while todo:
        v = todo.pop()
        if isinstance(v, dict | list):
            todo += v.values() if isinstance(v, dict) else v
        elif v is not None and v != "":
            out.add(str(v))
    return out


#: Parts of a wording that are blank whatever was called.
BLANKS = (UUID.pattern, r"'[^']*'", r"\[[^\]]*\]", r"\{\}")


def wording(text: str, known: set[str]) -> str:
    """A text with known values (longest first), ids, quotes and lists blank; blanks with nothing between them are one."""
    names = sorted((v for v in known if len(v) > 1), key=lambda v: (-len(v), v))
    first, *rest = re.split("|".join([*map(re.escape, names), *BLANKS]), text)
    parts = [first, *(p for p in rest[:-1] if p.strip()), *rest[-1:]]
    return "{}".join(parts).strip()


@vectorized("tool string, kind string, wording string")
def outcome_signature(observation: pd.Series, tool: pd.Series, arguments: pd.Series, record_ids: pd.Series) -> pd.DataFrame:
    """What kind of answer a call got, and its wording, in which the call's arguments and the record ids are known."""
    out = []
    for o, t, a, r in zip(observation, tool, arguments, record_ids, strict=True):
        x = observed(o)
        if isinstance(x, dict):
            failed = x.get("success") is False
            known = _scalars(_load(a)[1]).union(r if r is not None else ())
            said = next((str(x[k]) for k in ("error", "message") if x.get(k)), "")
            out.append((t, "error" if failed else "data" if "data" in x else "message", wording(said, known)))
        else:
            out.append((t, "other", ""))
    return pd.DataFrame(out, columns=["tool", "kind", "wording"])


#: Fixed order of what is masked: hosts, ids, addresses, dates, versions, sizes.
MASKS = (
    (re.compile(r"\b[\w-]+@[\w.-]+(?=:)"), "<host>"),
    (UUID, "<uuid>"),
    (re.compile(r"\b[0-9a-f]{12,64}\b"), "<hex>"),
    (re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), "<ip>"),
    (re.compile(r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+[\d:]{4,5}"), "<date>"),
    (re.compile(r"\bv?\d+\.\d+(?:\.\d+)+\b"), "<version>"),
    (re.compile(r"(?m)^total \d+"), "total <n>"),
)


_FIELDS = re.compile(r"(\s+)")
_RIGHTS = re.compile(r"[-bcdlps](?:[-r][-w][-xsStT]){3}[.+@]?")
_NAMED = re.compile(rf"\.(?:{'|'.join(FILE_ENDINGS)})$")
_LONG_ID = re.compile(r"(?=.*\d)[A-Za-z][\w-]{11,}")


class _Inventory:
    """Judges the words of a text: those that the episode was shown or that name nothing in particular stay."""

    def __init__(self, known: set[str], foreign: set[str]):
        self.known, self.foreign = known, foreign

    def stays(self, word: str) -> bool:
        word = word.rstrip("/.") or word
        parts = [x.lower() for x in word.split("/") if x]
        return word in self.known or word.rsplit("/", 1)[-1] in self.known or all(x in _GENERIC for x in parts)

    def hidden_as(self, word: str) -> str | None:
        """What stands for a word: by its kind if it is foreign, or names a path, a file or a long id."""
        if self.stays(word):
            return None
        if re.fullmatch(r"\d{3,}", word):
            return "<n>"
        ending = re.search(r"\.[A-Za-z0-9]{1,6}$", word)
        if word in self.foreign or "/" in word.strip("/") or word.startswith("/") or _NAMED.search(word) or _LONG_ID.fullmatch(word):
            return "<path>" if "/" in word else f"<file{ending[0]}>" if ending else "<name>"
        return None


_GENERIC = {x.lower().strip("/") for x in GENERIC_NAMES} | {".", "..", "~"}


def _listed(line: str, inventory: _Inventory) -> tuple[str, int]:
    """A row of a long listing with its size masked, and its name where the episode doesn't know it (a link by its own
    name); other lines as they are."""
    parts = _FIELDS.split(line, maxsplit=8)
    if len(parts) < 17 or not _RIGHTS.fullmatch(parts[0]) or not parts[8].isdigit():
        return line, 0
    parts[8] = "<n>"
    hidden = not inventory.stays(parts[16].split(" -> ")[0].strip())
    if hidden:
        parts[16] = "<name>"
    return "".join(parts), 1 + hidden


def masked(text: str, known: set[str], foreign: set[str]) -> tuple[str, int]:
    """Text with foreign values masked, and how many were: rows of long listings first, then values with a pattern of
    their own, then words that the inventories tell to hide, and longer numbers."""
    inventory = _Inventory(known, foreign)
    lines = [_listed(line, inventory) for line in text.split("\n")]
    text, n = "\n".join(x for x, _ in lines), sum(k for _, k in lines)
    for pattern, name in MASKS:
        text, k = pattern.subn(name, text)
        n += k
    out = []
    for word in re.split(r"(<[\w.]+>|[\w./~+@-]+)", text):
        name = inventory.hidden_as(word) if word and word[0] != "<" and not word.isspace() else None
        out.append(name or word)
        n += name is not None
    return "".join(out), n


@vectorized("text string, masked int")
def mask_foreign_values(text: pd.Series, known: pd.Series, foreign: pd.Series) -> pd.DataFrame:
    out = [masked(t or "", set(k if k is not None else ()), set(f if f is not None else ())) for t, k, f in zip(text, known, foreign, strict=True)]
    return pd.DataFrame(out, columns=["text", "masked"])


def scaffold(commands: list[str], user: str, host: str, cwd: str, sigil: str) -> list[str]:
    """The lines that a terminal echoes for commands before their output: prompt and command, continuation lines of a
    here-document, the directory after cd."""
    out, until = [], None
    for line in commands:
        if until is not None:
            out.append(f"> {line}")
            until = None if line.strip() == until else until
            continue
        out.append(f"{user}@{host}:{cwd}{sigil} {line}")
        here = HERE_DOCUMENT.search(line)
        until = here[1] if here else None
        words = words_of(line.strip())
        if words[:1] == ["cd"]:
            to = words[1] if len(words) > 1 else "~"
            parts = [] if to[:1] in "/~" else cwd.split("/")
            for p in to.split("/"):
                if p == "..":
                    parts = parts[:-1] if len(parts) > 1 else parts
                elif p not in ("", ".") or not parts:
                    parts.append(p)
            cwd = "/".join(parts) or "/"
    return out


@vectorized("array<string>")
def transcript_scaffold(commands: pd.Series, user: pd.Series, host: pd.Series, cwd: pd.Series, sigil: pd.Series) -> pd.Series:
    return pd.Series([scaffold(list(c) if c is not None else [], u or "", h or "", d or "", s or "$") for c, u, h, d, s in zip(commands, user, host, cwd, sigil, strict=True)])
