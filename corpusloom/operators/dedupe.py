"""Exact and near duplicates of chunks, evidence, sources, hits, uploads and questions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from corpusloom.functions.text import canonical_text, squeeze
from corpusloom.sources.stages import staged

ORDER = ["authority_priority", "document_id", "child_index", "chunk_id"]
EXEMPT = ["code", "formula", "table"]


def exact_dedupe(chunks: DataFrame, order: list[str] = ORDER) -> tuple[DataFrame, DataFrame]:
    """``(kept, duplicates(chunk_id, duplicate_of, kind))``; the first of equal canonical texts by ``order`` stays.

    The first is a minimum, combined before the shuffle, so a hot text doesn't meet in one task.
    Canonical forms are made once and staged; the duplicates are found without the texts.
    """
    keyed = staged(chunks.withColumn("canonical_hash", F.sha2(canonical_text(F.col("text"), F.col("knowledge_type")), 256)), "canonical")
    first = keyed.groupBy("canonical_hash").agg(F.min_by("chunk_id", F.struct(*order)).alias("first_id"))
    joined = keyed.join(first, "canonical_hash")
    kept = joined.where("chunk_id = first_id").drop("first_id")
    gone = joined.where("chunk_id <> first_id").select("chunk_id", F.col("first_id").alias("duplicate_of"), F.lit("exact").alias("kind"))
    return kept, gone


def first_texts(chunks: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """The rows of ``chunks`` that D1 keeps. Digests decide, so of the texts only the kept ones' rows are shuffled, and none is staged."""
    mark = F.xxhash64("text").alias("mark")  # with the id, tells rows apart whose ids repeat
    digest = F.unhex(F.sha2(canonical_text(F.col("text"), F.col("knowledge_type")), 256))
    first = chunks.select(digest.alias("digest"), F.struct(*order, mark).alias("place")).groupBy("digest").agg(F.min("place").alias("place"))
    first = staged(first.select("place.chunk_id", "place.mark"), "firsts")
    return chunks.withColumn("mark", mark).join(first, ["chunk_id", "mark"], "left_semi").drop("mark")


#: Digests of shingles that a task remembers, and shingles that are counted at a time.
SEEN, AT_ONCE = 2_000_000, 2_000_000


def simhash64(col: Column, shingle: int = 5, algorithm: str = "md5") -> Column:
    """SimHash of character shingles as a signed long; ties set the bit.

    ``algorithm`` is ``md5`` (its first 64 bits, as SQL engines have it) or ``blake2b``.
    Shingles are numbers, each different one of some texts is hashed once, and bits are
    counted eight to a word. Texts with signs too large for that are hashed shingle by shingle.
    """
    digest = {
        "md5": lambda b: hashlib.md5(b, usedforsecurity=False).digest()[:8],
        "blake2b": lambda b: hashlib.blake2b(b, digest_size=8).digest(),
    }[algorithm]
    bits = 60 // shingle

    def plain(t: str) -> int:
        grams = [t[k : k + shingle].encode() for k in range(max(1, len(t) - shingle + 1))]
        votes = np.zeros(64, dtype=np.int64)
        for at in range(0, len(grams), 1 << 14):
            raw = np.frombuffer(b"".join(map(digest, grams[at : at + (1 << 14)])), dtype=np.uint8)
            votes += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        return int.from_bytes(np.packbits(2 * votes >= len(grams)).tobytes(), "big")

    def digests(keys: np.ndarray) -> np.ndarray:
        signs = (keys[:, None] >> np.arange(0, shingle * bits, bits, dtype=np.uint64)) & np.uint64((1 << bits) - 1)
        grams = np.ascontiguousarray(signs.astype("<u4")).view(f"<U{shingle}").ravel().tolist()
        return np.frombuffer(b"".join(digest(g.encode()) for g in grams), ">u8").astype(np.uint64)

    def many(texts: list[np.ndarray], seen: list[np.ndarray]) -> np.ndarray:
        """The fingerprints of texts as code points, by the digests ``seen`` (sorted shingles and theirs), which grow."""
        whole = np.concatenate(texts).astype(np.uint64)
        n = np.array([len(t) - shingle + 1 for t in texts])
        ends = np.cumsum(n)
        key = sum(whole[i : len(whole) - shingle + 1 + i] << np.uint64(i * bits) for i in range(shingle))
        key = key[np.arange(ends[-1]) + np.repeat((shingle - 1) * np.arange(len(n)), n)]  # none across two texts
        code, unique = pd.factorize(key)
        at = np.searchsorted(seen[0], unique)
        known = at < len(seen[0])
        known[known] = seen[0][at[known]] == unique[known]
        own = np.zeros(len(unique), np.uint64)
        own[known], own[~known] = seen[1][at[known]], digests(unique[~known])
        if len(seen[0]) < SEEN:
            keys, values = np.concatenate([seen[0], unique[~known]]), np.concatenate([seen[1], own[~known]])
            order = np.argsort(keys)
            seen[:] = keys[order], values[order]
        h = own[code]
        pieces = -(-n // 255)  # a byte counts up to 255
        first = np.cumsum(pieces) - pieces
        starts = np.repeat(ends - n, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
        out = np.zeros(len(n), np.uint64)
        for j in range(8):
            sums = np.add.reduceat((h >> np.uint64(j)) & np.uint64(0x0101010101010101), starts)
            votes = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
            for i in range(8):
                out |= (2 * votes[:, i] >= n).astype(np.uint64) << np.uint64(8 * i + j)
        return out

    @F.pandas_udf(LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        for texts in batches:
            out = np.zeros(len(texts), dtype=np.uint64)
            rows, points, held = [], [], 0
            for i, t in enumerate(texts):
                t = t or ""
                signs = np.frombuffer(t.encode("utf-32-le"), "<u4")
                if len(t) < shingle or signs.max() >> bits or not signs.min():
                    out[i] = plain(t)
                    continue
                rows.append(i)
                points.append(signs)
                held += len(t)
                if held > AT_ONCE:
                    out[rows] = many(points, seen)
                    rows, points, held = [], [], 0
            if rows:
                out[rows] = many(points, seen)
            yield pd.Series(out.view(np.int64))

    return run(col)


def near_pairs(df: DataFrame, max_distance: int = 3, bucket_bits: int = 16, key: str = "chunk_id") -> DataFrame:
    """D3: ``(a, b, distance)``, a < b, of fingerprints ``fp`` in one bucket (their first bits) at most ``max_distance`` apart.

    The other bits are cut into ``max_distance + 1`` bands, one of which a pair within
    the distance must share, so the join is on equal keys and loses nothing.
    ``bucket_bits=0`` finds all pairs. Fingerprints should be distinct (exact dedupe
    first); each pair comes once.
    """
    bands = max_distance + 1
    rest = 64 - bucket_bits
    cuts = [rest * i // bands for i in range(bands + 1)]
    fp = F.col("fp")
    bucket = F.shiftrightunsigned(fp, rest) if bucket_bits else F.lit(0)
    band = F.array(*[
        F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
        for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
    ])
    posts = df.select(F.col(key), fp, bucket.cast("long").alias("bucket"), F.explode(band).alias("band"))
    a = posts.select(F.col(key).alias("a"), F.col("fp").alias("fa"), "bucket", "band")
    b = posts.select(F.col(key).alias("b"), F.col("fp").alias("fb"), "bucket", "band")
    distance = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))
    return a.join(b, ["bucket", "band"]).where("a < b").select("a", "b", distance.alias("distance")).where(F.col("distance") <= max_distance).distinct()


def dedupe(chunks: DataFrame, max_distance: int = 3, bucket_bits: int = 16, algorithm: str = "md5", order: list[str] = ORDER) -> tuple[DataFrame, DataFrame]:
    """Order-dependent near dedupe: a chunk goes only if an earlier chunk that *stays* is near.

    That is the lexicographically first maximal independent set of the candidate graph.
    Each round keeps what has no undecided or kept earlier neighbour, drops what has a
    kept one, and goes on with the rest; the smallest undecided chunk is always decided.
    """
    kept, gone = exact_dedupe(chunks, order)
    kept = staged(kept.withColumn("place", F.struct(*order)), "exact")
    prose = kept.where(~F.col("knowledge_type").isin(EXEMPT)).withColumn("fp", simhash64(canonical_text(F.col("text")), 5, algorithm))
    every = staged(prose.select("chunk_id", "fp", "place"), "fingerprints")
    # Of equal fingerprints the first decides for all: whatever earlier chunk drops it drops the others, else it does.
    prose = staged(every.groupBy("fp").agg(F.min_by("chunk_id", "place").alias("chunk_id"), F.min("place").alias("place")), "first-fingerprints")
    pairs = near_pairs(prose, max_distance, bucket_bits)
    place = prose.select("chunk_id", "place")
    pairs = pairs.join(place.select(F.col("chunk_id").alias("a"), F.col("place").alias("pa")), "a").join(
        place.select(F.col("chunk_id").alias("b"), F.col("place").alias("pb")), "b"
    )
    first = F.col("pa") < F.col("pb")
    edges = staged(pairs.select(  # from the earlier chunk to the later one
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late"),
        F.when(first, F.col("pa")).otherwise(F.col("pb")).alias("place"),
    ), "edges")
    state = staged(edges.select(F.col("late").alias("id")).union(edges.select("early")).distinct().withColumn("fate", F.lit("open")), "fates")
    while not state.where("fate = 'open'").isEmpty():
        seen = edges.join(state.select(F.col("id").alias("early"), F.col("fate").alias("early_fate")), "early")
        verdict = seen.groupBy(F.col("late").alias("id")).agg(
            F.max(F.col("early_fate") == "kept").alias("hit"), F.max(F.col("early_fate") == "open").alias("wait")
        )
        fate = F.when(F.col("fate") != "open", F.col("fate")).when(F.col("hit"), "gone").when(F.coalesce("wait", F.lit(False)), "open").otherwise("kept")
        state = staged(state.join(verdict, "id", "left").select("id", fate.alias("fate")), "fates")
    stays = state.where("fate = 'kept'").select(F.col("id").alias("early"))
    near = edges.join(stays, "early").join(state.where("fate = 'gone'").select(F.col("id").alias("late")), "late")
    near = staged(near.groupBy(F.col("late").alias("chunk_id")).agg(F.min_by("early", "place").alias("duplicate_of")), "near")
    others = every.join(prose.select("fp", F.col("chunk_id").alias("rep")), "fp").where("chunk_id <> rep").select("chunk_id", "rep")
    others = others.join(near.select(F.col("chunk_id").alias("rep"), "duplicate_of"), "rep", "left")
    near = staged(near.unionByName(others.select("chunk_id", F.coalesce("duplicate_of", "rep").alias("duplicate_of"))), "near")
    # Copies of a chunk that went as near share its fate: they point where it points.
    follow = near.select(F.col("chunk_id").alias("duplicate_of"), F.col("duplicate_of").alias("target"))
    copies = gone.join(follow, "duplicate_of", "left").select(
        "chunk_id", F.coalesce("target", "duplicate_of").alias("duplicate_of"), F.when(F.col("target").isNull(), "exact").otherwise("near").alias("kind")
    )
    return kept.drop("place").join(near, "chunk_id", "left_anti"), copies.unionByName(near.withColumn("kind", F.lit("near")))


def duplicate_ratio(chunks: DataFrame, duplicates: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document its chunks, duplicates, ratio and issue."""
    n = chunks.join(duplicates.select("chunk_id", F.lit(1).alias("gone")), "chunk_id", "left").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum("gone"), F.lit(0)).alias("n_duplicates")
    )
    ratio = F.col("n_duplicates") / F.col("n_chunks")
    issue = F.when(ratio > threshold, "duplicate_ratio_exceeded").when(F.col("n_duplicates") > 0, "duplicate_content")
    return n.select("*", ratio.alias("ratio"), issue.alias("issue"))


def new_uploads(uploads: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ("user_id", "content_hash"), order: str = "upload_id") -> DataFrame:
    """The first upload per key that isn't there already."""
    first = uploads.groupBy(*keys).agg(F.min(order).alias(order))
    return first.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def _first(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row per ``keys``: a minimum, combined before the shuffle, so a hot key doesn't meet in one task."""
    names = [f"_k{i}" for i in range(len(keys))]
    best = df.groupBy(*(k.alias(n) for k, n in zip(keys, names, strict=True))).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row"))
    return best.select("row.*")


def dedupe_evidence(df: DataFrame, chars: int = 500, request: str = "request_id", pos: str = "pos") -> DataFrame:
    """Per request the first of equal openings (lower case, squeezed, ``chars`` characters)."""
    mark = F.sha2(F.left(F.lower(squeeze(F.coalesce("text", F.lit("")))), F.lit(chars)), 256)
    return _first(df, [F.col(request), mark], [pos])


def dedupe_sources(df: DataFrame, cap: int | None = 18, request: str = "request_id", pos: str = "pos") -> DataFrame:
    """Per request and url (lower case, no fragment) the longest excerpt, then so per title; empty excerpts go."""
    url = F.regexp_replace(F.lower(F.col("url")), "#.*$", "")
    rows = df.where("length(excerpt) > 0").withColumn("url_key", url).withColumn("title_key", F.lower(squeeze(F.coalesce("title", F.lit("")))))
    rows = rows.withColumn("title_key", F.when(F.col("title_key") == "", F.col("url_key")).otherwise(F.col("title_key")))
    for key in ("url_key", "title_key"):
        best = Window.partitionBy(request, key).orderBy(F.desc(F.length("excerpt")), pos)
        rows = rows.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    if cap is not None:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(request).orderBy(pos))).where(F.col("n") <= cap).drop("n")
    return rows.drop("url_key", "title_key")


def merge_hits(hits: DataFrame, request: str = "query_id", pos: str = "pos") -> DataFrame:
    """First hit per content hash, else parent, else document."""
    key = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("content_hash", "parent_id", "document_id")])
    return _first(hits, [F.col(request), key], [pos])


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def bigram_jaccard(a: Column, b: Column) -> Column:
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    return F.size(F.array_intersect(grams(a), grams(b))) / F.greatest(F.size(F.array_union(grams(a), grams(b))), F.lit(1))


def similarity(a: Column, b: Column) -> Column:
    """The larger of sequence ratio and bigram Jaccard; under 8 characters the ratio alone."""
    ratio = sequence_ratio(a, b)
    return F.when(F.least(F.length(a), F.length(b)) < 8, ratio).otherwise(F.greatest(ratio, bigram_jaccard(a, b)))


def diversity_errors(questions: DataFrame, quiz: str = "quiz_id", pos: str = "pos") -> DataFrame:
    """Questions too close to an earlier one of their quiz: ``(quiz, pos, other_pos, reason)``.

    ``questions`` has ``stem, knowledge_point, explanation``; a quiz has six questions, so pairs stay within bounds.
    """
    norm = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")
    q = questions.select(quiz, pos, norm(F.col("stem")).alias("s"), norm(F.col("knowledge_point")).alias("k"), norm(F.col("explanation")).alias("e"))
    a, b = q.alias("a"), q.alias("b")
    pairs = a.join(b, (F.col(f"a.{quiz}") == F.col(f"b.{quiz}")) & (F.col(f"a.{pos}") > F.col(f"b.{pos}")))
    stem, point, expl = (similarity(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in "ske")
    pairs = pairs.select(
        F.col(f"a.{quiz}").alias(quiz), F.col(f"a.{pos}").alias(pos), F.col(f"b.{pos}").alias("other_pos"),
        stem.alias("stem"), point.alias("point"), expl.alias("expl"),
        (F.col("a.s") == F.col("b.s")).alias("same_stem"), ((F.col("a.k") == F.col("b.k")) & (F.col("a.k") != "")).alias("same_point"),
        ((F.col("a.k") == "") | (F.col("b.k") == "")).alias("no_point"), (F.least(F.length("a.k"), F.length("b.k")) >= 8).alias("long_points"),
    )
    close = F.col("long_points") & (
        (F.col("stem") >= 0.9) | (F.col("point") >= 0.7) | ((F.col("stem") >= 0.45) & (F.col("expl") >= 0.55))
    )
    reason = (
        F.when(F.col("same_stem"), "same_stem").when(F.col("same_point"), "same_point")
        .when((F.col("stem") >= 0.72) & (F.col("no_point") | (F.col("point") >= 0.9)), "similar_stem").when(close, "similar_content")
    )
    return pairs.select(quiz, pos, "other_pos", reason.alias("reason")).where("reason is not null")
