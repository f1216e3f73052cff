"""Language identification: scripts narrow the candidates, Viterbi over word scores labels spans."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import column, staged

LETTERS = r"\p{L}+"
_any_words = regex.compile(LETTERS).findall
#: The same on texts of code points up to 255 in lower case, three times as fast.
_latin_words = re.compile(r"[a-zªµºß-öø-ÿ]+").findall
#: First and last code points of scripts; a letter outside of all is of script "other".
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]


def script(word: str) -> str:
    """The script of a word's first letter."""
    return _script(word[0])


@lru_cache(maxsize=1 << 12)
def _script(letter: str) -> str:
    return next((name for name, first, last in SCRIPTS if first <= ord(letter) <= last), "other")


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text in lower case."""
    text = (text or "").lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _any_words(text)
    return _latin_words(text)


def _script_column(word):
    code = F.ascii(word)
    out = F.lit("other")
    for name, first, last in reversed(SCRIPTS):
        out = F.when(code.between(first, last), name).otherwise(out)
    return out


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    docs_per_lang: int = 1500, buckets: int = 1 << 18, max_langs: int = 500,
) -> dict:
    """Fit on a bounded sample of the labelled rows: ``docs_per_lang`` a language or so, by a hash of the id.

    Languages are counted on the narrow columns; the words of the sample are then counted
    once and staged. Letter trigrams are counted under CRC-32 modulo ``buckets``, so the
    model, which the driver and every worker hold, is bounded by parameters and no trigram
    is left out. Also kept: the scripts that hold a hundredth of a language's letters.
    Rows without text or label teach nothing. No labelled rows: an empty model.
    """
    rows = docs.select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)).alias("h"),
    ).where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs")
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "buckets": buckets, "place": {}, "logp": np.zeros((1, 0), dtype=np.float32), "allowed": {}}
    part = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / sizes[k])))])
    words = staged(
        rows.where(F.col("h") < part[F.col("lang")] * (1 << 30))
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("word"))
        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words",
    )
    shown = F.concat(F.lit("^"), "word", F.lit("$"))
    gram = F.expr("substring(shown, i, 3)")
    grams = (
        words.select("lang", "n", shown.alias("shown"), F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
        .groupBy("lang", (F.crc32(gram.cast("binary")) % buckets).alias("bucket")).agg(F.sum("n").alias("n")).collect()
    )  # fmt: skip  # at most buckets x languages
    own, place = {k: i for i, k in enumerate(langs)}, {}
    for r in grams:
        place.setdefault(r["bucket"], len(place))
    counts = np.full((len(place) + 1, len(langs)), 0.5)  # the last row: buckets not seen
    for r in grams:
        counts[place[r["bucket"]], own[r["lang"]]] += r["n"]
    logp = np.log(counts / counts.sum(axis=0))
    logp = np.clip(logp - logp.mean(axis=1, keepdims=True), -4, 4)
    letters = words.groupBy("lang", _script_column(F.col("word")).alias("script")).agg(F.sum(F.col("n") * F.length("word")).alias("n")).collect()
    total, seen = dict.fromkeys(langs, 0), {}
    for r in letters:
        total[r["lang"]] += r["n"]
    for r in letters:
        seen.setdefault(r["script"], np.zeros(len(langs), dtype=bool))[own[r["lang"]]] = r["n"] >= 0.01 * total[r["lang"]]
    return {"langs": langs, "buckets": buckets, "place": place, "logp": logp.astype(np.float32), "allowed": {k: v for k, v in seen.items() if v.any()}}


#: The score of a language whose script a word has not: no sum of switches outweighs it.
EXCLUDED = -1e9


class _Grams(dict):
    """Trigram -> its row in the model; those of buckets not seen share the last."""

    def __init__(self, model: dict):
        super().__init__()
        self.place, self.buckets = model["place"], model["buckets"]

    def __missing__(self, gram: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[gram] = row = self.place.get(zlib.crc32(gram.encode()) % self.buckets, len(self.place))
        return row


class WordScores(dict):
    """Word -> row of ``table``: the word's log score in each language.

    The script of a word narrows the candidates: languages without it are excluded. Words
    in a script that no language has say nothing (zero in all) and count for none.
    """

    def __init__(self, model: dict, room: int = 20 << 20):
        super().__init__()
        self.room, self.logp, self.grams = room, model["logp"].astype(np.float64), _Grams(model)
        self.scripts = {k: i for i, k in enumerate(model["allowed"])}
        n = len(model["langs"])
        self.allowed = np.stack([*model["allowed"].values(), np.zeros(n, dtype=bool)])  # the last: scripts of no language
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.held = 0
        self.table = np.zeros((0, self.logp.shape[1]))
        self.letters = np.zeros((0, 2), dtype=np.int32)  # of each word: all, and those that count for a language

    @property
    def full(self) -> bool:
        return self.held > self.room

    def learn(self, words: Iterable[str]) -> None:
        """Score the words that are not known yet, all at once."""
        new = [w for w in words if w not in self]
        for at in range(0, len(new), 1 << 14):
            part = new[at : at + (1 << 14)]
            shown = [f"^{w}$" for w in part]
            rows = np.fromiter((self.grams[s[i : i + 3]] for s in shown for i in range(len(s) - 2)), dtype=np.int32)
            size = np.array([len(w) for w in part])
            score = np.add.reduceat(self.logp[rows], np.cumsum(size) - size, axis=0)
            score = np.maximum(score - score.max(axis=1, keepdims=True), -12)  # no word outweighs many others
            allowed = self.allowed[[self.scripts.get(script(w), -1) for w in part]]
            some = allowed.any(axis=1)
            best = np.where(allowed, score, -np.inf).max(axis=1, keepdims=True, where=allowed, initial=-12)
            score = np.where(allowed, score - best, np.where(some[:, None], EXCLUDED, 0.0))
            first = len(self)
            self.update(zip(part, range(first, first + len(part)), strict=True))
            self.table = np.concatenate([self.table, score])
            self.letters = np.concatenate([self.letters, np.stack([size, size * some], axis=1).astype(np.int32)])
            self.held += 200 * len(part) + 2 * int(size.sum()) + score.nbytes


def viterbi(scores: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word of many texts at once, where each switch of language costs ``penalty``.

    ``ids`` are rows of ``scores``; text t's words are ``ids[start[t] : start[t] + size[t]]``.
    The texts advance together, word by word, longest first, so that a step is a few array operations.
    """
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")  # texts longer than t
    labels = np.zeros(len(ids), dtype=np.int16)
    stays = np.ones((len(ids), scores.shape[1]), dtype=bool)
    jumps = np.zeros(len(ids), dtype=np.int16)
    value = np.zeros((len(size), scores.shape[1]))
    for t, k in enumerate(active):
        at = start[:k] + t
        v = value[:k]
        if t:
            best = v.max(axis=1, keepdims=True)
            jumps[at] = v.argmax(axis=1)
            stays[at] = v >= best - penalty
            v = np.maximum(v - best, -penalty)
        value[:k] = v + scores[ids[at]]
    now = value.argmax(axis=1).astype(np.int16) if value.size else None
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        labels[at] = now[:k]
        now[:k] = np.where(stays[at, now[:k]], now[:k], jumps[at])
    return labels


def identify(
    docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0,
    words_at_once: int = 1_000_000, keep: list[str] | None = None, with_spans: bool = True,
) -> DataFrame:
    """``docs`` -> one row per row: id, ``lang_pred, score, n_spans, spans``.

    ``spans`` are the runs of words of one language as ``(lang, first_word, n_words)``;
    ``lang_pred`` has the most letters (ties: the first by name) and ``score`` their
    share of all letters; letters of scripts that no language has count for none. Texts
    that are null or hold no letter get ``und``, score 0 and no spans, as does every text
    under an empty model. Whole texts are read; nothing is shuffled. Rows that repeat get
    the same answer each; no rows give no rows.
    ``keep`` names columns of ``docs`` to return as the struct ``kept`` in place of the id
    (they ride along, so that a filter needs no join, whatever their names). Without
    ``with_spans`` the spans are counted but not returned.
    """
    whole, keep = bool(keep), keep or [id_col]
    kept = [docs.schema[c].dataType.simpleString() for c in keep]
    shape = ", ".join(f"_{i} {kind}" for i, kind in enumerate(kept))
    shape += ", lang_pred string, score double, n_spans long, spans array<struct<lang: string, first_word: long, n_words: long>>"

    held = docs.sparkSession.sparkContext.broadcast(model)  # at most buckets x languages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, words = held.value["langs"], WordScores(held.value)

        def decide(parts: list[np.ndarray]) -> pd.DataFrame:
            size = np.array([len(p) for p in parts], dtype=np.int64)
            end = np.cumsum(size)
            flat = np.concatenate(parts)
            length = words.letters[flat]
            label = viterbi(words.table, flat, end - size, size, penalty)
            out = []
            for b, e in zip(end - size, end, strict=True):
                if b == e:
                    out.append(("und", 0.0, 0, []))
                    continue
                own = label[b:e]
                share = np.bincount(own, weights=length[b:e, 1], minlength=len(langs))
                cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                runs = zip(cut.tolist(), np.diff(np.r_[cut, e - b]).tolist(), strict=True)
                spans = [{"lang": langs[own[i]], "first_word": i, "n_words": n} for i, n in runs] if with_spans else None
                out.append((langs[int(share.argmax())], float(share.max() / length[b:e, 0].sum()), len(cut), spans))
            return pd.DataFrame(out, columns=["lang_pred", "score", "n_spans", "spans"])

        for b in batches:
            first, parts, n = 0, [], 0
            lists: list[list[str]] = []
            waiting = 0
            for i, text in enumerate(b["text"]):
                lists.append(words_of(text) if langs else [])
                waiting += len(lists[-1])
                last = i == len(b) - 1
                if waiting < words_at_once // 10 and not last:
                    continue
                words.learn({w for found in lists for w in found})
                parts += [np.fromiter(map(words.__getitem__, found), dtype=np.int32, count=len(found)) for found in lists]
                n, lists, waiting = n + waiting, [], 0
                if n >= words_at_once or words.full or last:
                    rows = b.iloc[first : i + 1].drop(columns="text").reset_index(drop=True)
                    yield pd.concat([rows, decide(parts)], axis=1)
                    first, parts, n = i + 1, [], 0
                    if words.full:
                        words.clear()

    rows = docs.select(*(column(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, shape)
    rode = [F.col(f"_{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(F.struct(*rode).alias("kept") if whole else rode[0], "lang_pred", "score", "n_spans", "spans")


def held_out(id_col: str = "doc_id", folds: int = 5):
    """The rows that never teach: CRC-32 of the id as text divisible by ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0
