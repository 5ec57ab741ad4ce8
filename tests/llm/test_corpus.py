"""The corpus operators against brute force, the library, round trips and held-out labels, and on odd tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sitequarry.llm import common, decontaminate, htmltext, langid, licenses, pieces, quality, queries, sharding, simhash, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"row": F.lit(1), "score": F.lit("x"), "fp": F.lit("y"), "stats": F.lit("z"), "_id": F.lit(0), "key": F.lit(0), "label": F.lit("q")}) if extra else df


def prose(rng, n, words=None):
    words = words or ["stone", "river", "quiet", "under", "house", "green", "walk", "early", "light", "paper", "eight", "north", "salt", "wind", "table"]
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "er"]) for _ in range(n))


ODD = [None, "", " \t\n", "one", "one two", "one two three", "one two three", "ONE two three", "été ça où", "日本語 テキスト", "a\x00b c", "x" * 5000, " ".join(["w"] * 30000)]


# ---- 1 near copies ----


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=2):
    label = {i: i for i in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: find(i) for i in ids}


def near_texts(seed, n=60):
    rng = random.Random(seed)
    out = list(ODD)
    for _ in range(n):
        base = prose(rng, rng.choice([5, 60, 400]))
        out.append(base)
        for _ in range(rng.randint(0, 3)):
            words = base.split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
    return out


def test_simhash_equals_brute_force(spark):
    texts = near_texts(1)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1(docs_of(spark, texts, extra=True)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_spark_hashes_shingles_alike(spark):
    text = "Some Words of a été line"
    words = text.encode().lower().decode().split()
    own = spark.createDataFrame([(" ".join(words[:3]),)], "s string").select(F.xxhash64("s")).first()[0]
    assert own % 2**64 == xxhash.xxh64_intdigest(" ".join(words[:3]).encode(), 42)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_close_pairs_are_exact(spark, radius):
    rng = random.Random(radius)
    values = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(6):
            y = x
            for b in rng.sample(range(64), rng.randint(0, radius + 1)):
                y ^= 1 << b
            values.add(int(np.uint64(y).astype(np.int64)))
    values = sorted(values)
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
    got = {(r.u, r.v) for r in simhash.close_pairs(spark.createDataFrame([(v,) for v in values], "fp long"), radius).collect()}
    assert got == want


def test_thresholds_sum_to_the_general_pigeonhole_bound():
    found = np.array([[1, 1, 1], [500, 1, 1], [1, 500, 400], [300, 300, 300]], float)
    for radius in (2, 3, 5):
        chosen = simhash.allocate(found, [22, 21, 21], np.array([0.1, 0.1, 0.1]), radius)
        assert (chosen.sum(axis=1) == radius - 3 + 1).all() and chosen.min() >= -1
    assert simhash.allocate(found, [22, 21, 21], np.array([0.1] * 3), 2)[1][0] == -1


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64))
    bits[:, 40] = bits[:, 3]
    groups = simhash.correlated_parts(500, (bits.T @ bits).astype(float), 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert next(g for g in groups if 3 in g) == next(g for g in groups if 40 in g)
    assert max(map(len, groups)) - min(map(len, groups)) <= 2


def test_keep_one_keeps_one_of_each_group_and_rows_without_id(spark):
    rng = random.Random(3)
    a, b, c = prose(rng, 50), prose(rng, 50), prose(rng, 50)
    rows = [(5, a), (2, a), (None, b), (None, c), (7, c), (9, None), (8, ""), (2, a)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(df).collect()), key=str)
    assert kept == sorted([(2, a), (None, b), (7, c), (8, "")], key=str)
    assert simhash.keep_one(df).columns == df.columns


def test_components_of_chains_stars_and_copies(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(50)]
    got = {r.node: r.label for r in common.components(spark.createDataFrame([*chain, *star, (7, 7), (1, 0)], "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(51)}}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 2 licences ----


def test_licence_scan(spark):
    texts = [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved. all RIGHTS, reserved", "Released under the MIT License.",
        "Licensed under the Apache License, Version 2.0.", "cc bye", "cc by cc by", *ODD,
    ]
    got = [r for r in licenses.op2(docs_of(spark, texts, extra=True)).orderBy("doc_id").collect()]
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got[:7]] == [
        (7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc-4.0"), (12, 1, 7, 7, "gpl", "gpl,gpl-3.0"), (6, 2, 0, 3, "reserved", "reserved"), (5, 0, None, None, "", "mit"), (8, 0, None, None, "", "apache-2.0"),
        (2, 0, None, None, "", ""), (4, 2, 0, 2, "cc-by", "cc-by"),
    ]
    assert all(0 <= r.score <= 1 for r in got) and [r.n_words for r in got[7:10]] == [0, 0, 0]


def test_base_places_against_word_by_word_search():
    rng = random.Random(2)
    vocabulary = ["cc", "by", "all", "rights", "reserved", "general", "public", "license", "x", "é"]
    for _ in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
        row = licenses.scan(rng.choice([" ", ", ", "-"]).join(words))
        every = [i for p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert row[:4] == (len(words), len(every), min(every, default=None), max(every, default=None))


def test_contained_detections_are_suppressed_and_rules_are_many():
    found = licenses.detections(licenses.words_of("Licensed under CC BY-NC-SA 4.0"))
    assert [d[3] for d in found] == ["cc-by-nc-sa-4.0"]
    assert sum(map(len, licenses.rules().values())) >= 200


# ---- 3 pieces ----


def test_pieces_equal_the_library(spark):
    texts = [*ODD, "  lead", "trail  ", "a  b   c", "▁mark ▁▁ mark", "line\n\nbreak", "😀 emoji", *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]]
    own = pieces.pieces(queries.piece_model())
    assert own.by_words
    for t in texts:
        ids = own.ids(t)
        proto = own.model.encode(t or "", return_type="proto")
        assert ids.tolist() == [own.begin, *own.model.encode(t or ""), own.end]
        assert own.spans(t).tolist() == [[p.begin, p.end] for p in proto.pieces]
        assert own.decode(ids) == own.model.decode(ids.tolist())
    out = pieces.op3(docs_of(spark, texts), queries.piece_model()).orderBy("doc_id").collect()
    assert [r.n_tokens for r in out] == [len(own.ids(t)) for t in texts] and out[0].n_tokens == 2
    spans = pieces.encode(docs_of(spark, ["ab cd"]), queries.piece_model()).first()
    assert b"".join(b"ab cd"[s.begin : s.end] for s in spans.spans) == b"ab cd"
    assert pieces.decode(pieces.encode(docs_of(spark, texts), queries.piece_model()), queries.piece_model()).where("decoded != replace(coalesce(text, ''), '▁', ' ')").count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normalisation_by_the_compiled_map_equals_the_library(rule, squeeze):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    own = pieces.Pieces.__new__(pieces.Pieces)
    own.chars, own.squeeze, own.lead, own.escape = pieces.CharMap(proto.normalizer_spec.precompiled_charsmap), squeeze, True, True
    for text in ["ＡＢＣ　ｱｲｳ ﬁ ½", "  a  b  ", "", " ", "Å\tx\r\n y", "①②㍿ 日本", "éä x"]:
        want, offsets = library.normalize(text, with_offsets=True)
        got, places = own.normalise(text)
        assert got.decode() == want
        ends = [len(want[:k].encode()) for k in range(len(want) + 1)]
        assert [len(text.encode()[: places[e]].decode()) for e in ends] == list(offsets)


# ---- 4 shards ----


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_are_equal_gapless_and_keep_small_groups(spark, seed):
    rng = random.Random(seed)
    hot = prose(rng, 20)
    texts = [None, "", *[prose(rng, rng.randint(1, 60)) for _ in range(700)], *[hot] * 350, *["copy one two"] * 3]
    rng.shuffle(texts)
    out = sharding.place(docs_of(spark, texts, extra=True), range_rows=50).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    assert all(r["size"] == size(texts[r.doc_id]) and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in out)
    total = sum(map(size, texts))
    for s in range(16):
        own = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 16) <= 2 * max(map(size, texts))
    assert len({r.shard for r in out if texts[r.doc_id] == "copy one two"}) == 1
    assert len({r.shard for r in out if texts[r.doc_id] == hot}) > 1


def test_shards_of_odd_tables(spark, tmp_path):
    assert sharding.op4(docs_of(spark, [])).count() == 0
    assert {(r.shard, r.slot) for r in sharding.op4(docs_of(spark, [None])).collect()} == {(8, 0)}
    same = sharding.op4(docs_of(spark, ["same"] * 64)).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in same) == [4] * 16
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), (3, "c"), (3, "c")], "doc_id long, text string")
    assert sharding.op4(nulls).count() == 4
    sharding.write_shards(docs_of(spark, ["a", "b", "c"]), str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


# ---- 5 main text ----


def test_main_text():
    page = "<html><head><title>T</title><style>x{}</style></head><body><nav><ul><li>menu</ul></nav><div class='ad'>buy</div><article><h1>Head</h1><p><b>Some &amp; text<br>more<p>Second   one</p><div class='comments'><p>first!</p></div></article><footer>foot</footer>"
    assert htmltext.main_text(page) == "Head\nSome & text more\nSecond one"
    loose = "<body><div id='nav'>a</div><div>" + "<p>" + "long words " * 20 + "<p>short tail</div><form><p>mail</form><aside>side</aside></body>"
    assert htmltext.main_text(loose) == ("long words " * 20).strip() + "\nshort tail"
    around = "<body class='search-on'><div class='page-with-sidebar has-comments'><div class='sidebar'>side</div><section class='cookie-notice'>cookies</section><article><p>kept</p><aside>no</aside><section id='comments'>no</section></article><div role='navigation'>no</div><p hidden>no</p></div>"
    assert htmltext.main_text(around) == "kept"
    assert htmltext.main_text("<main><header><h1>T</h1></header><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>e  f</pre><form>x</form></main>") == "T\na\nb\nc\nd\ne f"
    assert htmltext.main_text("<script>if (a</p>b) x</script><p>y</p>") == "y"
    assert [htmltext.main_text(x) for x in (None, "", "<!-- x", "<p", "plain", "a &lt b &am")] == ["", "", "", "", "plain", "a < b &am"]
    assert len(htmltext.main_text("<p>" + "a" * 200_000 + "</p>" * 2000)) == 200_000
    assert htmltext.main_text("<div>" * 3000 + "deep") == "deep"


def test_main_text_of_pages_keeps_every_block_between(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>a</article>"), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(3))
    assert [tuple(r) for r in htmltext.op5(rows).orderBy("page_id").collect()] == [(1, "u", "a", 1), (2, None, "", 0)]


# ---- 6 vectors ----


def brute_links(rows, least=0.93):
    ok = {i: (lab, np.array(v, float)) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x for x in v)}
    links = {i: set() for i, _, _ in rows}
    for a, (la, va) in ok.items():
        for b, (lb, vb) in ok.items():
            if a != b and la == lb and len(va) == len(vb) and va @ vb / np.sqrt((va @ va) * (vb @ vb)) >= least:
                links[a].add(b)
    comp = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        comp[i] = min(seen)
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def vector_rows(seed, n=500, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 4)) if k % 4 == 0 else 1):
            rows.append(((base + rng.normal(size=dim) * 0.12).tolist(), int(k % 3)))
    dense = rng.normal(size=dim)
    rows += [((dense + rng.normal(size=dim) * 0.1).tolist(), 0) for _ in range(150)]
    rows += [(dense.tolist(), 0)] * 40
    rows += [(None, 1), ([0.0] * dim, 1), ([float("nan")] * dim, 1), ([1.0] * dim, None), ([1.0] * dim, None), ([None] * dim, 2), ([1e300] * dim, 2), ([2e300] * dim, 2), ([1e-200] * dim, 2), ([], 1), ([1.0, 0.0], 1), ([2.0, 0.0], 1)]
    return [(i, v, lab) for i, (v, lab) in enumerate(rows)]


@pytest.mark.parametrize("shard", [2000, 120])
def test_vectors_against_brute_force(spark, shard):
    rows = vector_rows(shard)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("component", F.lit(1))
    out, recall = vectors.near_vectors(df, shard=shard)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    want = brute_links([r for r in rows if not (r[1] and any(x and abs(x) in (1e300, 2e300, 1e-200) for x in r[1]))])
    assert set(got) == {r[0] for r in rows}
    found = sum(min(got[i][0], want[i][0]) for i in want)
    assert recall >= 0.9 and found >= 0.9 * sum(w[0] for w in want.values())
    huge = [r[0] for r in rows if r[1] and any(x and abs(x) in (1e300, 2e300, 1e-200) for x in r[1])]
    assert [got[i][0] for i in huge] == [2, 2, 2]
    if shard == 2000:
        assert {i: got[i] for i in want} == want


def test_vectors_of_an_empty_table(spark):
    assert vectors.op6(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- 7 language ----

LANGS = {"en": "the and of ing tion er th with that house river".split(), "de": "und der die ung sch ein ich keit straße über".split(), "fr": "le la de et eau eux ment que élève où".split()}


def language_docs(spark, n=300):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        rows.append((i, " ".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(5, 60))), lang, "s", 0))
    return spark.createDataFrame(rows + [(1000 + i, t, None, "s", 0) for i, t in enumerate(ODD)], DOCS)


def test_language_on_held_out_rows(spark):
    df = language_docs(spark)
    out = {r.doc_id: r for r in langid.op7(df.withColumn("row", F.lit(1))).collect()}
    rows = df.where("doc_id < 1000").collect()
    assert all(out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if out[r.doc_id].held_out]
    assert len(held) > 50 and sum(out[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert [out[1000 + i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in out.values())


def test_bundles_equal_the_definition():
    text = "Ab c, é日 x"
    symbols = [32, *map(ord, "ab"), 32, ord("c"), 32, ord("é"), ord("日"), 32, ord("x"), 32]
    want = sum(np.roll(langid.letter_vector(a), 2) * np.roll(langid.letter_vector(b), 1) * langid.letter_vector(c) for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False))
    both = langid.bundles([text, "", "zz"])
    assert np.allclose(both[0], want) and not both[1].any() and np.allclose(both[2], langid.bundles(["zz"])[0])


def test_language_without_labels_and_rows(spark):
    assert {r.lang_pred for r in langid.op7(docs_of(spark, ["a b"]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.op7(docs_of(spark, [])).count() == 0
    kept = langid.keep_identified(language_docs(spark))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") and kept.where("doc_id < 1000").count() == 300


# ---- 8 quality, 9 toxicity ----


def labelled(spark, kind):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(400):
        bad = rng.random() < 0.3
        text = prose(rng, rng.randint(20, 90))
        if kind == "quality" and bad:
            text = rng.choice([" ".join(w.upper() + "!!" for w in text.split()), " ".join([text.split()[0]] * 60), " ".join(w + "&&&" for w in text.split())])
        if kind == "toxic" and bad:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyword", "foulword", "vileword"]))
            text = " ".join(words)
        rows.append((i, text, "en", "s", 0))
        marks.append((i, int(not bad) if kind == "quality" else 1, int(bad) if kind == "toxic" else 0))
    marks += [(1000, None, None), (None, 1, 1), (2, None, None), (999, 1, 0)]
    odd = [(2000 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "text without an id", "en", "s", 0)]
    return spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind,op,parts,part", [("quality", quality.op8, 5, 0), ("toxic", toxicity.op9, 4, 2)])
def test_classifiers_on_held_out_rows(spark, kind, op, parts, part):
    docs, labels = labelled(spark, kind)
    out = {r.doc_id: r for r in op(docs.withColumn("score", F.lit("clash")), labels).collect()}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    truth = {r.doc_id: r[kind] for r in labels.where(f"{kind} is not null and doc_id < 400").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % parts == part]
    assert all(out[i].held_out for i in held) and not out[None].held_out
    assert sum(out[i].predicted == truth[i] for i in held) >= 0.95 * len(held)


@pytest.mark.parametrize("op,kind", [(quality.op8, "quality"), (toxicity.op9, "toxic")])
def test_classifiers_without_labels(spark, op, kind):
    docs, labels = labelled(spark, kind)
    none = op(docs, labels.limit(0)).collect()
    assert all(abs(r.score - 0.5) < 1e-9 for r in none) and len(none) == docs.count()
    alike = op(docs, labels.withColumn(kind, F.lit(1))).collect()
    assert all(r.predicted == 1 for r in alike)
    assert op(docs.limit(0), labels).count() == 0


def test_rules_compile_to_the_same_score(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.STATS)))
    y = ((x[:, 0] > 0.2) & (x[:, 3] <= 0.5)).astype(int)
    model = quality.fit(x, y)
    assert model.rules
    df = spark.createDataFrame([(i, tuple(map(float, row))) for i, row in enumerate(x)], "i int, stats struct<" + ",".join(f"{s}:double" for s in quality.STATS) + ">")
    got = {r.i: r.p for r in df.select("i", model.column(F.col("stats")).alias("p")).collect()}
    total = np.full(len(x), model.intercept)
    for w, rule in model.rules:
        total += w * quality.holds(rule, x)
    for w, name, low, high in model.terms:
        total += w * np.clip(x[:, quality.STATS.index(name)], low, high)
    assert np.allclose([got[i] for i in range(len(x))], 1 / (1 + np.exp(-total)))
    assert np.mean([(got[i] > 0.5) == y[i] for i in range(len(x))]) > 0.97


# ---- 10 decontamination ----


def best_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


def test_myers_equals_dynamic_programming():
    rng = random.Random(4)
    for _ in range(200):
        p = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 60)))
        d, hit = best_distance(p, t), decontaminate.Myers(p).best(t, len(p))
        assert (hit[0] if hit else len(p)) == min(d, len(p))


def decontamination_tables(spark):
    rng = random.Random(5)
    words = ["alpha", "bravo", "carbon", "delta", "ember", "falcon", "garden", "harbor", "island", "jungle", "kernel"]
    items = [prose(rng, rng.randint(8, 30), words) for _ in range(12)] + ["short", None, ""]
    texts = list(ODD)
    for item in items[:12]:
        for edits in (0, 1, 3, 6):
            chars = list(item)
            for _ in range(edits):
                k = rng.randrange(len(chars))
                chars[k : k + 1] = rng.choice([[], ["z"], [chars[k], "q"]])
            texts.append(f"{prose(rng, 20)}\n{''.join(chars).upper()}, {prose(rng, 15)}")
    texts += [prose(rng, 60) for _ in range(20)]
    return docs_of(spark, texts, extra=True), texts, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), items


def test_decontamination_finds_all_within_the_budget(spark):
    docs, texts, bench, items = decontamination_tables(spark)
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.op10(docs, bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        folded = decontaminate.fold(t)
        for k, item in enumerate(items):
            own = decontaminate.fold(item)
            if not own or len(folded) >= 3000:
                continue
            if not decontaminate.budget(own):
                if f" {own} " in f" {folded} ":
                    want[i, k] = 0
            elif (d := best_distance(own, folded)) <= decontaminate.budget(own):
                want[i, k] = d
    assert got == want and len(want) > 24
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_short_items_match_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "2 + 2"), (3, "?!"), (4, "one two three")], "item_id long, text string")
    docs = docs_of(spark, ["he asked: what is the CAPITAL, of france", "capital of france", "2-2=0", "22", "bone two threes", "One, two: three!", "one two three one two three"])
    assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.op10(docs, bench).collect()} == {(0, 1, 0), (2, 2, 0), (5, 4, 0), (6, 4, 0)}
    assert {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()} == {1, 3, 4}


def test_decontamination_in_groups_and_of_empty_tables(spark, monkeypatch):
    docs, _, bench, _ = decontamination_tables(spark)
    want = {tuple(r) for r in decontaminate.op10(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 1200)
    assert {tuple(r) for r in decontaminate.op10(docs, bench).collect()} == want
    assert decontaminate.op10(docs, bench.limit(0)).count() == 0 and decontaminate.op10(docs.limit(0), bench).count() == 0


# ---- the pipeline ----


def test_pipeline_against_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        after = {r.doc_id: r.text for r in kept.collect()}
        assert after.items() <= before.items()
        if name == "near_copies":
            from test_near_copies import brute_jaccard_kept

            assert set(after) == brute_jaccard_kept(before)
        if name == "decontaminate":
            items = [decontaminate.fold(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            dirty = {i for i, t in before.items() if any(x in decontaminate.fold(t) for x in items)}
            assert dirty and not dirty & set(after)
        kept = spark.createDataFrame([(i, t, None, None, None) for i, t in sorted(after.items())], DOCS)
    own = pieces.pieces(queries.piece_model())
    out = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert out == {r.doc_id: len(own.ids(r.text)) for r in kept.collect()}


def test_stages_keep_clashing_columns_nulls_and_empty_tables(spark, tmp_path):
    docs = docs_of(spark, [*ODD, "The river and the house were quiet under the early light of the north wind"] * 2, extra=True)
    rng = random.Random(1)
    words = [prose(rng, 40) for _ in range(40)]
    labelled_docs = docs.unionByName(docs_of(spark, words, extra=True).withColumn("doc_id", F.col("doc_id") + 100))
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    for stage in (langid.keep_identified, lambda d: quality.keep_good(d, labels), simhash.keep_one, lambda d: decontaminate.keep_clean(d, bench)):
        out = stage(labelled_docs)
        assert out.columns == labelled_docs.columns and 0 < out.count() <= labelled_docs.count()
        assert stage(labelled_docs.limit(0)).count() == 0
    for op in (simhash.op1, licenses.op2, sharding.op4, langid.op7, lambda d: pieces.op3(d, queries.piece_model()), lambda d: decontaminate.op10(d, bench)):
        assert op(docs).count() in (docs.count(), 0) and op(docs.limit(0)).count() == 0
        nulls = docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
        assert op(nulls).count() in (docs.count(), 0)


def test_every_operator_has_a_query():
    names = [n for n in queries.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
