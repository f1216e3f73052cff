"""Token counts and ids of a word-level BPE tokenizer, with a whole-token shortcut."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks; no threads inside them

VOCABULARY = "word_bpe_49k.json"
#: Characters on which the tokenizer's normaliser (NFC, white space, lower case) and the pattern below agree
#: with Python's. In a text with others only the chunks that hold one go to the library; a text with a special
#: token's opening goes there as a whole.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÿ]*")
#: White space that no pre-token spans and no normalisation crosses.
GAP = re.compile(r"[\t\n\r ]+")
#: The pre-tokens of such a text after lower-casing.
PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t\n\r 0-9a-zß-öø-ÿ]+"
).findall
#: Bytes of chunks that a worker remembers, their overhead included.
CACHE = 40 << 20
#: Longer chunks are not remembered.
LONGEST = 64


@lru_cache(maxsize=2)
def tokenizer(name: str = VOCABULARY):
    """The library's tokenizer; ``name`` is a file of the public vocabularies, or a path."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's characters and their bytes: printable ones stand for themselves, others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def whole_tokens(name: str = VOCABULARY) -> dict[str, int]:
    """The strings that are one pre-token and encode alone as one token, with its id.

    Each word-final vocabulary string is decoded and proved through the library
    before any text is seen; what fails (unreachable merges, other cases) is left out.
    """
    tok, back, found = tokenizer(name), byte_alphabet(), {}
    for piece in tok.get_vocab(with_added_tokens=False):
        if piece.endswith("</w>") and all(c in back for c in piece[:-4]):
            try:
                text = bytes(back[c] for c in piece[:-4]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if PLAIN.fullmatch(text) and PIECES(text) == [text]:
                found[text] = tok.token_to_id(piece)
    texts = list(found)
    encoded = tok.encode_batch(texts, add_special_tokens=False)
    return {t: found[t] for t, e in zip(texts, encoded, strict=True) if e.ids == [found[t]]}


class Table(dict):
    """White-space-free chunk -> its count, or its ids as bytes.

    Pre-tokens never span white space, so a chunk's value is put together from its
    pre-tokens': a look-up for those proved ``whole``, the model's merges for the rest.
    Chunks that are not plain are the library's. ``tally`` counts pre-tokens by way.
    """

    def __init__(self, name: str, whole: dict[str, int], value: Callable[[list[int]], object]):
        super().__init__()
        self.tok, self.value, self.whole, self.held, self.old = tokenizer(name), value, whole, 0, {}
        self.merge = self.tok.model.tokenize
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.tally = {"whole": 0, "merged": 0, "library": 0}

    def __missing__(self, chunk: str):
        """From the older half of what is remembered, or made anew; when the younger half is full, the older one goes."""
        v = self.old.get(chunk)
        if v is None:
            v = self._make(chunk)
        if len(chunk) <= LONGEST:
            self.held += 200 + 2 * len(chunk) + (len(v) if isinstance(v, bytes) else 4)
            if 2 * self.held > CACHE:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[chunk] = v
        return v

    def _make(self, chunk: str):
        if PLAIN.fullmatch(chunk):
            ids = []
            for w in PIECES(chunk):
                one = self.whole.get(w)
                if one is not None:
                    ids.append(one)
                    self.tally["whole"] += 1
                else:
                    w = w if w.isascii() else "".join(map(self.shown.__getitem__, w.encode("utf-8")))
                    ids.extend([t.id for t in self.merge(w)])
                    self.tally["merged"] += 1
        else:
            ids = self.tok.encode(chunk, add_special_tokens=False).ids
            self.tally["library"] += 1
        return self.value(ids)

    def of(self, text: str | None) -> Iterable:
        """The values of a text's chunks in order."""
        text = text or ""
        if PLAIN.fullmatch(text) and "<|" not in text:
            return map(self.__getitem__, text.lower().split())
        if "<|" in text:
            return [self.value(self.tok.encode(text, add_special_tokens=False).ids)]
        return [self[c.lower() if PLAIN.fullmatch(c) else c] for c in GAP.split(text) if c]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` -> one row per row: id, ``n_bytes, n_tokens, over_limit``.

    Counts are the library's own, without added special tokens; special strings in a
    text are what the library takes them for. Pre-tokens proved whole cost a lookup
    (the proof is made once, here, and sent to the workers); only the rest is merged,
    each once per worker while it is remembered, in at most ``CACHE`` bytes. Null texts
    count as empty; rows that repeat are counted one by one, no rows give no rows. No
    shuffle; other columns are not read.
    """
    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary))  # at most the vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Table(vocabulary, proved.value, len)
        for b in batches:
            yield b[["id", "n_bytes"]].assign(n_tokens=[sum(table.of(t)) for t in b["text"]])

    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")
    ).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInPandas(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
