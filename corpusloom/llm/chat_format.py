"""Chat formatting: schema fingerprints select declarative mappings into canonical turns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template; inside a role or text each is preceded by a backslash, as is a backslash.
START, STOP = "### ", "</turn>\n"
_escape = re.compile(r"\\|###|</turn>")
_unescape = re.compile(r"\\(\\|###|</turn>|n)")
_turn = re.compile(r"### ((?:\\.|[^\\\n])*)\n((?:\\.|[^\\])*?)</turn>\n", re.S)

#: Layouts that are known. A layout lists its field paths (``[]`` is any element); those after ``?`` may be absent.
#: ``turns`` is (path of the list, role field, text field); ``parts`` are (role, path) in order.
LAYOUTS = [
    {"paths": ["messages[].content", "messages[].role"], "turns": ("messages", "role", "content")},
    {"paths": ["conversations[].from", "conversations[].value"], "turns": ("conversations", "from", "value")},
    {"paths": ["prompt", "response", "?system"], "parts": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"paths": ["prompt", "completion", "?system"], "parts": [("system", "system"), ("user", "prompt"), ("assistant", "completion")]},
    {"paths": ["instruction", "output", "?input", "?system"], "parts": [("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")]},
    {"paths": ["question", "answer.text", "?context"], "parts": [("system", "context"), ("user", "question"), ("assistant", "answer.text")]},
]
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value, at: str = "") -> set[str]:
    """The nested field paths of a decoded record; list elements share one path."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(layouts: list[dict] = LAYOUTS) -> dict[str, dict]:
    """Fingerprint -> mapping, for every choice of a layout's optional paths."""
    out = {}
    for layout in layouts:
        fixed = [p for p in layout["paths"] if p[0] != "?"]
        loose = [p[1:] for p in layout["paths"] if p[0] == "?"]
        for pick in product([True, False], repeat=len(loose)):
            out[fingerprint([*fixed, *(p for p, yes in zip(loose, pick, strict=True) if yes)])] = layout
        if "turns" in layout:
            out[fingerprint([f"{layout['turns'][0]}[]"])] = layout  # no turns
    return out


def _get(value, path: str):
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record, mapping: dict) -> list[tuple[str, str]]:
    """Canonical ``(role, text)`` turns of a decoded record; null texts are empty, absent parts make no turn."""
    if "turns" in mapping:
        path, role, text = mapping["turns"]
        rename = ROLES if path == "conversations" else {}
        pairs = [(_text(m.get(role)), _text(m.get(text))) for m in _get(record, path) or []]
        return [(rename.get(r, r), t) for r, t in pairs]
    names = {p.lstrip("?") for p in mapping["paths"] if p[0] == "?"}
    return [(r, _text(_get(record, p))) for r, p in mapping["parts"] if p not in names or p.split(".")[0] in record]


def escape(text: str) -> str:
    return _escape.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _unescape.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the loss mask: the spans of the assistants' texts in it."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head = START + escape(role).replace("\n", "\\n") + "\n"
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, STOP]
        at += len(head) + len(body) + len(STOP)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turn.finditer(formatted)]


def format_records(df: DataFrame, id_col: str = "conv_id", record_col: str = "record", layouts: list[dict] = LAYOUTS) -> DataFrame:
    """JSON records of mixed layouts -> one row per row: id, ``schema, formatted, loss_mask, error``.

    ``schema`` is the fingerprint of the record's field paths, by which its mapping is
    found. ``loss_mask`` is ``array<struct<start, end>>`` in code points of
    ``formatted``. Records that are null or no JSON object, or whose fingerprint no
    layout has, get a null ``formatted`` and an ``error``; none is dropped. A record is
    one conversation and is handled whole. No shuffle; other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    known = registry(layouts)

    def one(raw: str | None) -> tuple:
        try:
            record = json.loads(raw) if raw is not None else None
        except ValueError:
            record = None
        if not isinstance(record, dict):
            return None, None, None, "not a JSON object"
        schema = fingerprint(field_paths(record))
        if schema not in known:
            return schema, None, None, "unknown layout"
        formatted, mask = render(turns_of(record, known[schema]))
        return schema, formatted, [{"start": a, "end": b} for a, b in mask], None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, *one(raw)) for key, raw in zip(b["id"], b["record"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", "schema", "formatted", "loss_mask", "error"])

    shape = f"id {kind}, schema string, formatted string, loss_mask array<struct<start: int, end: int>>, error string"
    rows = df.select(F.col(id_col).alias("id"), F.col(record_col).cast("string").alias("record"))
    return rows.mapInPandas(run, shape).withColumnRenamed("id", id_col)


def records_from_turns(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` -> ``(conv_id, record)``, each in the tightest of three layouts.

    user, assistant: ``prompt``/``response``; system, user, assistant: those with
    ``system``; all others: ``messages``. Turns are ordered by turn, then role and text;
    null roles and texts are empty, repeated rows are turns of their own. Rows without
    ``conv_id`` belong to no conversation that could be told, so each is one by itself.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    own = F.when(F.isnull("conv_id"), F.monotonically_increasing_id()).alias("own")
    conv = rows.select("conv_id", "turn", "role", "text", own).groupBy("conv_id", "own").agg(turns.alias("t"))
    roles = F.transform("t", lambda t: t["role"])
    these = lambda *names: roles == F.array(*map(F.lit, names))
    text = lambda i: F.try_element_at("t", F.lit(i))["text"]
    pair = F.to_json(F.struct(text(1).alias("prompt"), text(2).alias("response")))
    led = F.to_json(F.struct(text(1).alias("system"), text(2).alias("prompt"), text(3).alias("response")))
    each = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    record = F.when(these("user", "assistant"), pair).when(these("system", "user", "assistant"), led)
    return conv.select("conv_id", record.otherwise(F.to_json(F.struct(each.alias("messages")))).alias("record"))


def read_back(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of formatted conversations, from the output alone: turns, loss text and lengths.

    Records that ``format_records`` could not format stay, with nulls.
    """
    kind = df.schema[id_col].dataType.simpleString()
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, formatted, mask in zip(b["id"], b["formatted"], b["loss_mask"], strict=True):
                if formatted is None:
                    out.append((key, *[None] * 5))
                    continue
                turns = parse(formatted)
                loss = "".join(unescape(formatted[m["start"] : m["end"]]) for m in mask)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((key, len(turns), sha(whole), len(loss), sha(loss), len(formatted)))
            names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names if c.startswith(("n_", "loss_c", "form"))})

    rows = df.select(F.col(id_col).alias("id"), "formatted", "loss_mask")
    shape = f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInPandas(run, shape).withColumnRenamed("id", id_col)
