"""Phrase collocations: frequency-ranked ids, pairs counted in direct-address tiles, frequent pairs ranked again as units."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.ranks import ranked
from corpusloom.llm.shared import staged

#: A-Z in lower case, every sign that ends a piece as a line feed, every blank as a space.
FORM = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: A break between pieces, or a word that is in no frequent phrase; and a frequent unit without a rank.
NONE, RARE = -1, -2
#: Bytes of text that are taken apart at once, pairs that are counted at once, different words that a task holds.
BLOCK, PAIRS, WORDS = 1 << 21, 1 << 21, 300_000
#: The longest word, in bytes, of those that are broadcast.
SHORT = 64
MASK = (1 << 64) - 1


def parts(text: bytes) -> Iterator[bytes]:
    """A text in its form, cut between pieces where it is longer than a block."""
    text, at = text.translate(FORM), 0
    while len(text) - at > BLOCK:
        end = text.rfind(b"\n", at, at + BLOCK)
        end = text.find(b"\n", at + BLOCK) if end < 0 else end
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:] if at else text


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, list[int]]]:
    """Texts of one language put together, about a block at a time, and how many bytes each has."""
    for b in batches:
        codes, texts = b.column("lang").dictionary_encode(), b.column("text").cast(pa.binary())
        of = codes.indices.to_numpy()
        for k, lang in enumerate(codes.dictionary.to_pylist()):
            some, size = [], 0
            for i in np.flatnonzero(of == k):
                for part in parts(texts[int(i)].as_py()):
                    some.append(part)
                    size += len(part)
                    if size >= BLOCK:
                        yield lang, b"\n".join(some), [len(s) for s in some]
                        some, size = [], 0
            if some:
                yield lang, b"\n".join(some), [len(s) for s in some]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, word, n)``, and under the null word how many there are; what a task has is added up later."""

    def rows(seen: dict[str, Counter]) -> pa.RecordBatch:
        langs = [lang for lang, c in seen.items() for _ in range(len(c))]
        words = pa.array([w for c in seen.values() for w in c], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), words, pa.array([n for c in seen.values() for n in c.values()], pa.int64())], ["lang", "word", "n"])

    seen: dict[str, Counter] = {}
    for lang, data, _ in blocks(batches):
        words = data.split()
        own = seen.setdefault(lang, Counter())
        own.update(words)
        own[None] += len(words)
        if sum(map(len, seen.values())) > WORDS:
            yield rows(seen)
            seen = {}
    yield rows(seen)


@dataclass
class Bits:
    """A set of hashes as a bitmap of bounded size: it may hold too much, never too little. Without ``words`` it is empty."""

    size: int
    words: np.ndarray | None = None

    @classmethod
    def of(cls, hashes: DataFrame, size: int) -> Bits:
        """``hashes(h)`` -> the bitmap; ``size`` / 64 rows reach the driver at most."""
        found = hashes.groupBy(F.expr(f"pmod(h, {size}) div 64").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pmod(h, {size}) % 64))")).alias("bits"))
        got = found.toPandas()
        if not len(got):
            return cls(size)
        words = np.zeros(-(-size // 64), dtype=np.int64)
        words[got["at"].to_numpy()] = got["bits"].to_numpy()
        return cls(size, words)

    def hold(self, h: np.ndarray) -> np.ndarray:
        if self.words is None:
            return np.zeros(len(h), dtype=bool)
        slot = h % self.size
        return (self.words[slot >> 6] >> (slot & 63)) & 1 == 1


def mix(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of tuples of ids, for ``Bits`` only: what it confuses costs time, not results."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.astype(np.int64)


@dataclass
class Words:
    """Ids of words: the most frequent ones by rank, other frequent ones by a hash that no other word shares."""

    ranks: dict[str, dict[bytes, int]]
    seed: int
    rest: Bits

    def ids(self, lang: str, words: list[bytes]) -> np.ndarray:
        get = self.ranks.get(lang, {}).get
        ids = np.fromiter((get(w, NONE) for w in words), np.int64, len(words))
        if self.rest.words is None:
            return ids
        import xxhash

        head, known = f"{self.seed}:{lang}\0".encode(), {}
        missing = np.flatnonzero(ids == NONE)
        for i in missing.tolist():
            w = words[i]
            if w not in known:
                h = (xxhash.xxh64_intdigest(head + w, seed=42) | (1 << 63)) - (1 << 64)
                known[w] = min(h, RARE)
            ids[i] = known[w]
        ids[missing[~self.rest.hold(ids[missing])]] = NONE
        return ids


def rare_id(seed: int) -> Column:
    """The same id of a word in SQL: negative, and never ``NONE``."""
    h = F.xxhash64(F.concat(F.lit(f"{seed}:"), "lang", F.lit("\0"), "word"))
    return F.least(h.bitwiseOR(F.lit(-(1 << 63))), F.lit(RARE).cast("long"))


def sequences(rows: DataFrame, words: Words) -> DataFrame:
    """``rows(lang, text)`` -> ``(ids)``: one row a text (or part of one) with ``NONE`` between runs of two frequent words or more."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, sizes in blocks(batches):
            raw = np.frombuffer(data, np.uint8)
            blank = (raw == 32) | (raw == 10)
            starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(raw) else np.zeros(0, np.int64)
            piece = np.cumsum(raw == 10, dtype=np.int32)[starts]
            ids = shared.value.ids(lang, data.split())
            after = (ids[:-1] != NONE) & (ids[1:] != NONE) & (piece[:-1] == piece[1:])  # a word and the next are together
            joined = np.concatenate([[False], after]) | np.concatenate([after, [False]]) if len(ids) else np.zeros(0, bool)
            first = joined & ~np.concatenate([[False], after]) if len(ids) else joined
            own = np.searchsorted(np.cumsum(np.array(sizes) + 1), starts, side="right")  # the text of each word
            at = np.flatnonzero(joined)
            breaks = np.cumsum(first[at])  # a break before each run
            out = np.full(len(at) + (int(breaks[-1]) if len(at) else 0), NONE, dtype=np.int64)
            out[np.arange(len(at)) + breaks] = ids[at]
            n = np.bincount(own[at], minlength=len(sizes)) + np.bincount(own[np.flatnonzero(first)], minlength=len(sizes))
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))], ["ids"])

    return rows.mapInArrow(run, "ids array<long>").where("size(ids) > 0")


@dataclass
class Units:
    """Ranks of the most frequent phrases of one length by (unit before the last word, last word), and a bitmap of the others."""

    keys: np.ndarray
    ranks: np.ndarray
    rest: Bits

    @classmethod
    def of(cls, first: np.ndarray, last: np.ndarray, rank: np.ndarray, rest: Bits) -> Units:
        keys = (first << 32) | last
        order = np.argsort(keys)
        return cls(keys[order], rank[order].astype(np.int64), rest)


def tally(first: np.ndarray, last: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of ranks as ``first << 32 | last``, and how often they come.

    Low ranks are frequent, so the pairs crowd in the first tiles of ``tile`` x ``tile``
    ranks. A tile with a pair for every sixteenth cell or more is counted in a dense
    table with an address for each cell; the others are sorted coordinates.
    """
    across = int(last.max()) // tile + 1 if len(last) else 1
    number = first // tile * across + last // tile
    rest, keys, counts = np.ones(len(first), dtype=bool), [], []
    for t in np.flatnonzero(np.bincount(number) >= tile * tile // 16):
        here = number == t
        rest &= ~here
        u, v = t // across * tile, t % across * tile
        cells = np.bincount((first[here] - u) * tile + last[here] - v, minlength=tile * tile)
        some = np.flatnonzero(cells)
        keys.append(((some // tile + u) << 32) | (some % tile + v))
        counts.append(cells[some])
    key, n = np.unique((first[rest] << 32) | last[rest], return_counts=True)
    return np.concatenate([*keys, key]), np.concatenate([*counts, n])


def tally_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of ids and how often they come: sorted coordinates."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return rows[at], np.diff(np.concatenate([at, [len(rows)]]))


def units_at(ids: np.ndarray, levels: list[Units]) -> np.ndarray:
    """The unit of 1 + len(``levels``) words that starts at each id: its rank, ``RARE`` or ``NONE``."""
    unit = np.where(ids >= 0, ids, np.where(ids == NONE, NONE, RARE))
    for k, level in enumerate(levels, 1):
        n = max(0, len(ids) - k)
        both = np.flatnonzero((unit[:n] != NONE) & (unit[1 : n + 1] != NONE)) if n else np.zeros(0, np.int64)
        found = np.full(len(both), NONE, dtype=np.int64)
        head, last = unit[both], ids[both + k]
        ranked_ = (head >= 0) & (last >= 0)
        if len(level.keys):
            key = (head[ranked_] << 32) | last[ranked_]
            at = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
            found[ranked_] = np.where(level.keys[at] == key, level.ranks[at], NONE)
        if level.rest.words is not None:
            open_ = np.flatnonzero(found == NONE)
            held = level.rest.hold(mix([ids[both[open_] + j] for j in range(k + 1)]))
            found[open_[held]] = RARE
        unit = np.full(len(ids), NONE, dtype=np.int64)
        unit[both] = found
    return unit


def count_phrases(seq: DataFrame, levels: list[Units], tile: int) -> DataFrame:
    """``seq(ids)`` -> phrases of 2 + len(``levels``) words with counts to be added up: ``(a, b, rest, n)``.

    A phrase whose first words are a ranked unit and whose last word has a rank is
    ``a``, ``b``; any other is the ids of its words, from the third in ``rest``. Only places
    where both the phrase without its last word and that without its first are
    frequent are counted: no other can be.
    """
    shared, size = seq.sparkSession.sparkContext.broadcast(levels), 2 + len(levels)
    kinds = [("a", pa.int64()), ("b", pa.int64()), ("rest", pa.list_(pa.int64())), ("n", pa.int64())]

    def dense(first: list[np.ndarray], last: list[np.ndarray]) -> pa.RecordBatch:
        key, n = tally(np.concatenate(first), np.concatenate(last), tile)
        return pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.nulls(len(key), kinds[2][1]), pa.array(n)], schema=pa.schema(kinds))

    def sparse(some: list[np.ndarray]) -> pa.RecordBatch:
        rows, n = tally_rows(np.concatenate(some))
        rest = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (size - 2)), pa.array(np.ascontiguousarray(rows[:, 2:]).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, 0])), pa.array(np.ascontiguousarray(rows[:, 1])), rest, pa.array(n)], schema=pa.schema(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, other, held = [], [], [], 0
        for b in batches:
            column = b.column("ids")
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            for at in range(0, len(ends) - 1, 512):  # sequences begin with NONE, so they can be taken together
                ids = values[ends[at] : ends[min(at + 512, len(ends) - 1)]]
                unit, n = units_at(ids, shared.value), len(ids) - size + 1
                if n <= 0:
                    continue
                place = np.flatnonzero((unit[:n] != NONE) & (unit[1 : n + 1] != NONE))
                head, tail = unit[place], ids[place + size - 1]
                known = (head >= 0) & (tail >= 0)
                first.append(head[known])
                last.append(tail[known])
                if not known.all():
                    place = place[~known]
                    other.append(np.stack([ids[place + j] for j in range(size)], axis=1))
                held += len(head)
                if held >= PAIRS:
                    yield dense(first, last)
                    if other:
                        yield sparse(other)
                    first, last, other, held = [], [], [], 0
        if first:
            yield dense(first, last)
        if other:
            yield sparse(other)

    return seq.mapInArrow(run, "a long, b long, rest array<long>, n long")


def _hashes(phrases: DataFrame) -> DataFrame:
    """``phrases(ids)`` of one length -> ``(h)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array(b.column("ids").to_pylist(), dtype=np.int64)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(mix(list(rows.T)))], ["h"])

    return phrases.select("ids").mapInArrow(run, "h long")


def frequent_phrases(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 5, least: int = 100, ranked_words: int = 1 << 17,
    ranked_units: int = 1 << 19, tile: int = 1024, bits: int = 1 << 24,
) -> tuple[DataFrame, DataFrame]:
    """``docs`` -> ``(phrases(lang, phrase, size, f), totals(lang, n))``: all phrases of 1 to ``longest`` words with ``f >= least``.

    Words are counted in the tasks and added up. The ``ranked_words`` most frequent ones
    have their rank as id and are broadcast; other frequent words have a hash that is
    checked to be no other word's, so their ids are as exact. Texts become sequences of ids
    once. Then, length by length, ``count_phrases`` counts pairs of a unit and a word by
    tiles; the frequent ones are ranked again and are the units of the next length. Only the
    ``ranked_units`` first are broadcast; places of others are let through by a bitmap of
    ``bits`` bits and counted as tuples of ids. These parameters bound memory, and change
    no count. See ``collocations`` for odd rows.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    every = staged(rows.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f")), "phrase-words")
    totals = every.where("word is null").select("lang", F.col("f").alias("n"))
    words = every.where(f"word is not null and f >= {least}").withColumns({"one": F.lit(""), "down": -F.col("f")})
    words = staged(ranked(words, ["one"], ["down", "lang", "word"]), "phrase-ranks")
    is_ranked = f"rank < {ranked_words} and octet_length(word) <= {SHORT}"
    other = words.where(f"not ({is_ranked})")
    seed = 0
    if not other.isEmpty():
        for seed in count():
            mine = other.select(rare_id(seed).alias("h")).distinct()
            same = every.where("word is not null").select(rare_id(seed).alias("h")).join(mine, "h", "left_semi").groupBy("h").count()
            if same.where("count > 1").isEmpty():
                break
    words = words.select("lang", "word", "f", F.when(F.expr(is_ranked), F.col("rank")).otherwise(rare_id(seed)).alias("id"))
    words = staged(words, "phrase-ids")
    ranks: dict[str, dict[bytes, int]] = {}
    top = words.where("id >= 0").toPandas()  # at most ranked_words rows of SHORT bytes
    for lang, word, i in zip(top["lang"], top["word"], top["id"], strict=True):
        ranks.setdefault(lang, {})[word.encode()] = i
    rare = Bits.of(words.where("id < 0").select(F.col("id").alias("h")), bits)
    seq = staged(sequences(rows, Words(ranks, seed, rare)), "phrase-sequences")

    found = [words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f", F.array("id").alias("ids"))]
    single = words.select("lang", "word", F.col("id").alias("last"))
    levels: list[Units] = []
    units = None  # (unit, head): ids of the ranked phrases one word shorter
    for size in range(2, longest + 1):
        now = count_phrases(seq, levels, tile).groupBy("a", "b", "rest").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        now = staged(now, "phrase-counts")
        ids = F.concat(F.array("a", "b"), F.coalesce("rest", F.array().cast("array<long>")))
        if size > 2:
            known = now.where("rest is null").join(units, F.col("a") == F.col("unit")).select("a", "b", "rest", "f", F.concat("head", F.array("b")).alias("ids"))
            now = known.unionByName(now.where("rest is not null").withColumn("ids", ids))
        else:
            now = now.withColumn("ids", ids)
        before = found[-1].select(F.col("ids").alias("head"), F.col("phrase").alias("start"))
        now = now.withColumns({"head": F.slice("ids", 1, size - 1), "last": F.element_at("ids", -1)}).join(before, "head").join(single, "last")
        now = staged(now.select("lang", F.concat_ws(" ", "start", "word").alias("phrase"), F.lit(size).alias("size"), "f", "ids", "a", "b", F.isnull("rest").alias("paired")), "phrases")
        found.append(now.select(*found[0].columns))
        if size == longest or now.isEmpty():
            break
        order = now.where("paired").select("a", "b", "ids", F.lit("").alias("one"), (-F.col("f")).alias("down"))
        order = staged(ranked(order, ["one"], ["down", "ids"]), "phrase-units")
        units = order.where(F.col("rank") < ranked_units).select(F.col("rank").alias("unit"), F.col("ids").alias("head"), "a", "b")
        top = units.select("a", "b", "unit").toPandas()  # at most ranked_units rows
        left = now.where("not paired").select("ids").unionByName(order.where(F.col("rank") >= ranked_units).select("ids"))
        levels.append(Units.of(top["a"].to_numpy(), top["b"].to_numpy(), top["unit"].to_numpy(), Bits.of(_hashes(left), bits)))
        units = units.select("unit", "head")
    return reduce(DataFrame.unionByName, [f.drop("ids") for f in found]), totals


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 5, least: int = 100, share: int = 100, top: int = 2000, **bounds: int
) -> DataFrame:
    """``docs`` -> the ``top`` phrases a language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase's score is the least of its cuts into two parts, ``1000 * a * n // (l * r)`` in
    38-digit decimals (exact while 1000 * a * n has no more digits), ties to the first cut.
    Phrases inside a longer one that has ``share`` hundredths of their count or more go. Null
    languages are ``und``, null texts empty; ids aren't read, repeated rows count as often as
    they come, and a text of any length is read whole (cut between pieces where it is longer
    than a block). Ties in score and count are in byte order. No rows give no rows. A phrase
    lies in one language, so a hot language spreads over all tasks.
    """
    found, totals = frequent_phrases(docs, lang_col, text_col, longest, least, **bounds)
    found = staged(found, "phrases-all")
    long = found.where("size > 1")
    part = "substring_index(phrase, ' ', {})"
    cuts = long.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr(part.format("k")), "second": F.expr(part.format("k - size"))})
    side = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("second", "r"), ["lang", "second"]).join(totals, "lang")
    wide = {c: f"cast({c} as decimal(19, 0))" for c in "flrn"}
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {wide['f']} * {wide['n']}) div ({wide['l']} * {wide['r']})")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "n")).alias("best"), F.first("f").alias("a"))
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(0, size - m), i -> array_join(slice(split(phrase, ' '), i + 1, m), ' '))))")
    around = long.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    rows = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.n", "best.score")
    rank = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)").cast("long")
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
