"""Phrase mining against a plain version, with the bounds so low that every path is taken."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import differences, duck

from corpusloom.llm import phrases
from corpusloom.llm.queries import oracle_sql, queries

SHAPE = "doc_id long, lang string, text string, rank int, word string, `a.b` int"


def plain(rows, longest=5, least=100, share=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        c = {p: a for p, a in c.items() if a >= least}
        found = []
        for p, a in c.items():
            if len(p) == 1:
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in c.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, t[2].decode(), -t[1], t[3], t[4], n[lang], -t[0]) for i, t in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(n=400, words=30, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"{'Wo' if i % 3 else 'é'}{i}" for i in range(words)] + ["x" * 90, " ", "#"]
    rows = []
    for i in range(n):
        text = "".join(vocabulary[int(rng.paretovariate(0.6)) % len(vocabulary)] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((i if i % 5 else None, ["en", "de", None, "und", ""][min(i % 11, 4)], text if i % 13 else None, 7, "w", 1))
    rows += [(1, "en", "the same old words again. The same old words", 0, None, None)] * 40 + [(2, "fr", "", 1, "", 1), (3, "fr", " .,; ", 1, "", 1)]
    return rows


@pytest.mark.parametrize("bounds", [{}, {"ranked_words": 5, "ranked_units": 3, "tile": 2, "bits": 64}, {"ranked_words": 12, "ranked_units": 40, "tile": 4}, {"ranked_words": 0, "ranked_units": 0}])
def test_plain_version(spark, monkeypatch, bounds):
    rows = texts()
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    got = sorted(map(tuple, phrases.collocations(df, least=12, top=60, **bounds).collect()))
    want = plain(rows, least=12, top=60)
    assert got == want and {r[0] for r in got} >= {"en", "de", "und"} and max(len(r[2].split(" ")) for r in got) == 5


def test_share_and_length(spark):
    rows = texts(seed=9)
    df = spark.createDataFrame(rows, SHAPE)
    assert sorted(map(tuple, phrases.collocations(df, longest=3, least=20, share=70).collect())) == plain(rows, 3, 20, 70)


def test_no_rows_and_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], SHAPE)).count() == 0
    one = phrases.collocations(spark.createDataFrame([(1, "en", "a b c", 1, "", 1), (2, None, None, 1, "", 1)], SHAPE))
    assert one.count() == 0 and one.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_long_text_is_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 50)
    text = ("aa Bb cc. dd, " * 40 + "e" * 200 + " f. g h").encode()
    cut = list(phrases.parts(text))
    assert len(cut) > 5 and b"\n".join(cut) == text.translate(phrases.FORM)
    assert b"\n".join(phrases.parts(b"no break at all " * 20)) == (b"no break at all " * 20)


def test_tiles_count_as_sorting_does():
    rng = np.random.default_rng(5)
    first, last = (np.minimum(rng.zipf(1.3, 40_000), 5000) - 1 for _ in range(2))
    key, n = phrases.tally(first, last, 32)
    want = Counter(zip(first.tolist(), last.tolist(), strict=True))
    assert dict(zip(zip((key >> 32).tolist(), (key & 0xFFFFFFFF).tolist(), strict=True), n.tolist(), strict=True)) == want
    rows = np.stack([first - 5, last, last % 3], axis=1)
    got, n = phrases.tally_rows(rows)
    assert dict(zip(map(tuple, got.tolist()), n.tolist(), strict=True)) == Counter(map(tuple, rows.tolist()))


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = queries()["op12_phrase_mining"](spark, sf)
    assert df.count() > 20 and not differences(df, duck(sf), oracle_sql()["op12_phrase_mining"])
