"""All pairs of texts by exact Jaccard: whole, and bounded in what is shuffled."""

import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from sitequarry.functions import text as tx
from sitequarry.operators import overlap, similarity


def changed(rng, words, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def texts_of(seed=3):
    """Dense groups of near copies of all lengths, a passage in most texts, exact copies, short and empty texts."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(40)]
    out = []
    for length, members in [(5, 2), (9, 4), (30, 12), (120, 40), (400, 25), (3000, 5)]:
        for _ in range(2):
            base = [f"w{rng.randrange(3000)}" for _ in range(length)]
            out += [" ".join(changed(rng, base, rng.choice([0, 0.002, 0.005, 0.01, 0.02]))) for _ in range(members)]
    out += [" ".join([f"v{rng.randrange(3000)}" for _ in range(rng.randrange(5, 60))] + passage) for _ in range(150)]
    out += [out[0], out[7], out[7].upper(), out[20].replace(" ", ", "), "Straße İstanbul 日本語 x² y", "straße i̇stanbul 日本語 x² y", "a b c d", "", " ", "one two three four five", "ONE two three four-five"]
    return out


def brute(sets, threshold):
    out = {}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common / len(sets[a] | sets[b]) >= threshold - 1e-12:
                out[a, b] = common / len(sets[a] | sets[b])
    return out


def sql_rows(path):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/documents.parquet/*.parquet')")
    return {(a, b): j for a, b, j in con.execute(__spark_entry__.oracle_sql()["exact_jaccard_pairs"]).fetchall()}


def spark_rows(spark, path):
    rows = __spark_entry__.queries()["exact_jaccard_pairs"](spark, str(path)).collect()
    assert len({(r.a, r.b) for r in rows}) == len(rows)
    return {(r.a, r.b): r.jaccard for r in rows}


@pytest.mark.parametrize("small", [False, True])
def test_query_equals_sql_over_dense_groups(spark, tmp_path, monkeypatch, small):
    if small:  # groups of many blocks, values beyond the join, parities compared in parts
        for name, value in {"ROWS": 3, "MEMBERS": 700, "FEW": 2, "AT_ONCE": 256, "FREQUENT": 5}.items():
            monkeypatch.setattr(overlap, name, value)
    rows = [(1000 - k, t) for k, t in enumerate(texts_of())] + [(2000, None), (None, "one two three four five"), (None, "no id six seven eight nine")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = sql_rows(tmp_path)
    assert spark_rows(spark, tmp_path) == pytest.approx(want) and len(want) > 350


def test_texts_under_one_id_are_one_set_as_in_sql(spark, tmp_path):
    texts = texts_of(5)[:90]
    rows = [(k % 80, t) for k, t in enumerate(texts)] + [(3, texts[3]), (500, texts[40]), (500, texts[85]), (40, texts[41])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert spark_rows(spark, tmp_path) == pytest.approx(sql_rows(tmp_path))


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
def test_pairs_of_sets_equal_brute_force(spark, threshold):
    rng = random.Random(7)
    sets = {f"id{k}": frozenset(rng.sample(range(40), rng.randrange(0, 30))) for k in range(80)}
    df = spark.createDataFrame([(k, [f"s{v}" for v in s]) for k, s in sets.items()], "id string, shingles array<string>")
    got = similarity.jaccard_pairs(df, threshold=threshold)
    assert {(r.a, r.b): r.jaccard for r in got.collect()} == pytest.approx(brute(sets, threshold))
    assert similarity.jaccard_pairs(df.limit(0), threshold=threshold).count() == 0


def test_sets_are_those_of_the_expression(spark):
    texts = [t for t in texts_of() if t][:60] + ["a b a b a b a b a b", "a b c d e f", "tab\tand\nline\x0bfeed\x0cones\x1cin a\x85row"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(tx.plain_words("text").alias("plain"), tx.shingles("text", 5).alias("s"))
    one = overlap.hashed_shingles(5)()
    assert all(len(one([r.plain])) == len(r.s) for r in df.collect())


def test_tables_on_disk_hold_a_fraction_of_the_shingles(spark, tmp_path, monkeypatch):
    """All that is cut holds less than one value for each shingle; before, whole sets were cut, and shuffled three times."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(20000)}" for _ in range(rng.randrange(200, 600))) for _ in range(300)]
    texts += [" ".join(changed(rng, texts[k % 20].split(), 0.01)) for k in range(60)]
    shingles = sum(len(t.split()) - 4 for t in texts)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    written = []
    from sitequarry.plans import lineage

    def counted(df, few=False, cut=lineage.cut):
        out = cut(df, few)
        written.append(sum(p.stat().st_size for p in Path(out._cut_path.removeprefix("file:")).glob("*.parquet")))
        return out

    for module in (overlap, similarity):
        monkeypatch.setattr(module, "cut", counted)
    got = spark_rows(spark, tmp_path)
    assert len(got) > 50 and sum(written) < 5 * shingles
