"""The bootstrap as a whole against a plain loop over lists of words, on texts with signs, tabs and line ends around them."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import pii

SHAPE = "doc_id long, text string"
SIGNS = re.compile(r"^[^\w@+]+|(?<=[^\W_])[\W_]+$")


def core(word):
    if not any(c.isalnum() for c in word):
        return "", 0
    lead = 0
    while not (word[lead].isalnum() or word[lead] in "@+"):
        lead += 1
    end = len(word)
    while not word[end - 1].isalnum():
        end -= 1
    return word[lead:end], lead


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def plain(docs, least=0.8, support=3):
    """Added spans of each document; base matches of the texts are e-mails and phones only."""
    places, seeds, taken = [], set(), set()
    for d, text in docs:
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        low = [w.lower() for *_, w in words]
        spans = base(text)
        keys = [("key", m.start(), m.end()) for m in re.finditer(pii.KEY, text)]
        for i, (a, z, w) in enumerate(words):
            left = ("L", low[i - 2], low[i - 1]) if i > 1 else None
            around = ("LR", low[i - 1], low[i + 1]) if i and i + 1 < len(words) else None
            places.append((d, i, a, z, w, [p for p in (left, around) if p]))
            for kind, s, e in spans + keys:
                if s < z and a < e:
                    taken.add((d, i))
                    if a <= s:
                        after = next((k for k in range(i + 1, len(words)) if words[k][0] >= e), None)
                        both = ("LR", low[i - 1], low[after]) if i and after is not None else None
                        seeds |= {(p, text[s:e]) for p in (left, both) if p}
    slots = [(d, a + lead, c, ps) for d, i, a, _, w, ps in places for c, lead in [core(w)] if c and (d, i) not in taken]
    every = [(c, ps) for *_, w, ps in places for c, _ in [core(w)] if c]
    mentioned, known = set(seeds), set()
    while True:
        good = defaultdict(set)
        for p, x in mentioned:
            good[p].add(x)
        new = {p for p, xs in good.items() if len(xs) >= support} - known
        known |= new
        prior = {(p, x): 1.0 for p, x in seeds if p in known}
        for _, _, c, ps in slots:
            for p in ps:
                if p in known:
                    prior[p, c] = max(prior.get((p, c), 0), pii.LOOKS if re.search("[0-9@_]", c) else pii.PLAIN)
        score = defaultdict(float)
        for (_, x), v in prior.items():
            score[x] = max(score[x], v)
        top, before = dict(score), -1
        while True:
            rated = defaultdict(list)
            for p, x in prior:
                rated[p].append(score[x])
            strong = {p: sum(v) / (len(v) + 1) for p, v in rated.items() if sum(x >= least for x in v) >= support}
            strong = {p: v for p, v in strong.items() if v >= least}
            score = dict(top)
            for p, x in prior:
                score[x] = max(score[x], strong.get(p, 0))
            now = sum(v >= least for v in score.values())
            if now == before:
                break
            before = now
        fresh = {x for x, v in score.items() if v >= least} - {x for _, x in seeds}
        more = seeds | {(p, c) for c, ps in every if c in fresh for p in ps}
        if not fresh or more <= mentioned or not {p for p, xs in group(more).items() if len(xs) >= support} - known:
            break
        mentioned = more
    return {d: sorted({(a, a + len(c)) for dd, a, c, ps in slots if dd == d and any(p in strong for p in ps)}) for d, _ in docs}


def group(pairs):
    out = defaultdict(set)
    for p, x in pairs:
        out[p].add(x)
    return out


def found(spark, docs, **kw):
    df = spark.createDataFrame(docs, SHAPE).repartition(4)
    return {r.doc_id: sorted((m.start, m.end) for m in r.added) for r in pii.find_pii(df, **kw).collect()}


def test_signs_after_the_instances_hide_no_pattern(spark):
    docs = [(i, f"please mail to bob{i}@example.org{end} today") for i, end in enumerate(["", ",", ";", ")"] * 5)]
    docs += [(100 + i, f"the\tway{i} of\nlife, number {'x' * i} is long") for i in range(40)] + [(500, "please mail to\tuser_4711;\nthanks")]
    got = found(spark, docs)
    assert got[500] == [(15, 24)] and got == plain(docs)


@pytest.mark.parametrize("seed", range(4))
def test_any_texts(spark, seed):
    rng = random.Random(seed)
    lead = ["mail to", "write  to:", "Call me", "account of", "the of"]
    common = ["the", "of", "and", "Haus", "über", "t", "n", "x0b", "\\"]

    def value(kind):
        if kind == "email":
            return f"p{rng.randint(0, 60)}@ex{rng.randint(0, 4)}.org"
        if kind == "phone":
            return f"+49{rng.randint(10**7, 10**8)}"
        return f"user_{rng.randint(0, 40)}" if kind == "user" else rng.choice(common)

    docs = []
    for d in range(120):
        bits = []
        for _ in range(rng.randint(0, 8)):
            bits += rng.choices(common, k=rng.randint(0, 3))
            i = rng.randrange(len(lead))
            kind = rng.choices(["email", "phone", "user", "word"], [[8, 0, 2, 0], [6, 0, 2, 1], [0, 7, 1, 0], [3, 0, 6, 0], [1, 1, 0, 12]][i])[0]
            bits += [lead[i], rng.choice(["", "(", "<", '"']) + value(kind) + rng.choice(["", ",", ";", ")", '">', "...", "t"]), rng.choice(["now", "", "please"])]
        docs.append((d, "".join(b + rng.choice([" ", " ", "\t", "\n", "\r\n", "  "]) for b in bits)))
    got = found(spark, docs)
    assert got == plain(docs) and sum(map(len, got.values())) > 0


def test_common_patterns_are_given_up_early(spark, monkeypatch):
    seen, standing = [], pii._standing
    monkeypatch.setattr(pii, "_standing", lambda docs, block: seen.append(standing(docs, block).count()) or standing(docs, block))
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    texts = [(i, i, f"so part of the {word(i)} is") for i in range(3000)] + [(5000, 5000, "please mail  to bob\tnow"), (5001, 5001, " \tmail to, (ÜBER) x\n")]
    docs = spark.createDataFrame(texts, "id long, row long, text string")
    every = {(r.id, r.place, r.start, r.end) for r in pii.cored(pii.slots(docs, block=2).where("id >= 5000")).collect()}
    assert every == {(5000, 0, 0, 11), (5000, 13, 13, 15), (5000, 16, 16, 19), (5000, 20, 20, 23), (5001, 2, 2, 6), (5001, 7, 7, 9), (5001, 11, 12, 16), (5001, 18, 18, 19)}
    common, rare = [docs.where(f"id = {i}").select(pii.pattern_of(*map(F.lit, w))[0].alias("p")).first().p for i, w in ((0, ("of", "the", "")), (5000, ("please mail", "to", "")))]
    mentioned = spark.createDataFrame([(p, i) for p in (common, rare) for i in range(5)], "pattern long, instance long")
    assert [r.pattern for r in pii.promising(docs, mentioned, 0.8, 3).collect()] == [rare]
    assert len(seen) == 2 and 7 < seen[0] < 400 and seen[1] <= 1  # all 3,000 texts have the common pattern
