"""Language identification and toxicity from end to end against plain Python versions of their definitions."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np

from sitequarry.llm import langid, toxicity

MASK = (1 << 64) - 1


def grams(text):
    """Letter triples of a lower-case text, a space for each run of other characters and at both ends."""
    symbols = [" "]
    for c in text.lower() + " ":
        c = c if c.isalpha() else " "
        if c != " " or symbols[-1] != " ":
            symbols.append(c)
    return zip(symbols, symbols[1:], symbols[2:], strict=False) if len(symbols) > 2 else []


def vector(text, known={}):  # noqa: B006
    own = known.get(text)
    if own is None:
        own = np.zeros(langid.DIMENSIONS)
        counts = {}
        for g in grams(text or ""):
            counts[g] = counts.get(g, 0) + 1
        for (a, b, c), n in counts.items():
            va, vb, vc = (langid.letter_vector(langid.SPACE if x == " " else ord(x)).astype(float) for x in (a, b, c))
            own += n * np.roll(va, 2) * np.roll(vb, 1) * vc
        known[text] = own
    return own


def test_language_identification_from_end_to_end(spark):
    """Also of a text above a block, of texts without letters, of repeated ids, and of a tie between two languages that learn the same texts."""
    rng = random.Random(1)
    words = {"aa": ["haus", "baum", "straße", "über"], "bb": ["the", "house", "tree", "of"], "cc": ["maison", "arbre", "été", "où"], "dd": ["maison", "arbre", "été", "où"]}
    rows = []
    for k in range(120):
        lang = "abcd"[k % 4] * 2
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 25)))
        rows.append((k, text, lang))
    same = "maison, arbre 12 été"
    rows += [(500 + k, same, lang) for k in range(40) for lang in ("cc", "dd")]
    rows += [(1, "the tree", "bb"), (900, "haus baum " * 60_000, None), (901, "12 - !", None), (902, None, "aa"), (903, "", None), (904, "Q", None), (None, "the house", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sums = {}
    seen = set()
    for doc_id, text, lang in rows:
        out = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1
        if out or lang is None or (doc_id, lang, text) in seen:
            continue
        seen.add((doc_id, lang, text))
        v = vector(text)
        if np.linalg.norm(v):
            sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
    prototypes = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items())}
    got = langid.op7(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for doc_id, text, _ in rows:
        v = vector(text)
        cosines = {k: float(p @ v / np.linalg.norm(v)) for k, p in prototypes.items()} if np.linalg.norm(v) else {}
        want.setdefault(doc_id, []).append(cosines)
    for r in got:
        options = want[r.doc_id]
        assert any((not c and (r.lang_pred, r.score) == ("und", 0.0)) or (c and abs(max(0.0, max(c.values())) - r.score) < 1e-4 and c[r.lang_pred] >= max(c.values()) - 1e-5) for c in options), (r, options)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert {r.lang_pred for r in got} >= {"aa", "bb", "und"}


def features(text):
    """Words, neighbours and skip pairs of a text as numbers, without blocks."""
    h = [zlib.crc32(w.encode()) for w in re.findall(r"\w+", (text or "").lower())]
    out = {x * 0x9E3779B97F4A7C15 & MASK for x in h}
    for skip in toxicity.SKIPS:
        for a, b in zip(h, h[skip + 1 :], strict=False):
            out.add(((a * 0xC2B2AE3D27D4EB4F & MASK) ^ (b * 0x165667B19E3779F9 & MASK) ^ ((skip + 1) * 0x27D4EB2F)) * 0x9E3779B97F4A7C15 & MASK)
    return sorted({x >> (64 - toxicity.HASH_BITS) for x in out})


def ftrl(rows, alpha=4.0, beta=1.0, l1=8.0, l2=0.1, epochs=8):
    """FTRL-proximal with one rate a coordinate, by dictionaries; the intercept starts at the share's log odds and has no penalty."""
    share = sum(y for _, y in rows) / len(rows)
    start = math.log(share / (1 - share))
    z, n, zb, nb = {}, {}, 0.0, 0.0

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            b = start - zb / ((beta + math.sqrt(nb)) / alpha)
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()) + b)))) - y
            for i in x:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i]
                n[i] = old + g * g
            zb, nb = zb + g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * (b - start), nb + g * g
    return {i: weight(i) for i in z}, start - zb / ((beta + math.sqrt(nb)) / alpha)


def test_toxicity_from_end_to_end(spark):
    """Also of a text above a block of words, of empty and null texts, repeated rows and ids, and of other columns of the same names."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    rows, marks = [], []
    for k in range(160):
        bad = k % 3 == 0
        text = [rng.choice(vocabulary) for _ in range(rng.randint(5, 30))] + (["you", "fool", "Idiot"] if bad else ["kind", "words"])
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
        if k % 5:
            marks.append((k, int(bad)))
    rows += [(3, rows[3][1]), (3, "another fool"), (200, None), (201, ""), (202, "fool idiot " * 140_000), (None, "you fool")]
    marks += [(3, 1), (7, None), (8, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    by_id = {d: m for d, m in marks if m in (0, 1)}
    learned = {(d, by_id[d], t) for d, t in rows if d in by_id and zlib.crc32(str(d).encode()) % 4 != 2}
    held = [(d, y, np.array(features(t), np.int64)) for d, y, t in learned]
    held.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1], len(r[2]), r[2].tobytes()))
    w, b = ftrl([(x.tolist(), y) for _, y, x in held])
    want = sorted((str(d), round(1 / (1 + math.exp(-max(-35, min(35, sum(w.get(i, 0.0) for i in features(t)) + b)))), 4)) for d, t in rows)
    got = toxicity.op9(docs, labels).collect()
    assert sorted((str(r.doc_id), round(r.score, 4)) for r in got) == want
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(v != 0 for v in w.values()) > 0 and {r.predicted for r in got} == {0, 1}
