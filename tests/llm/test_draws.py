"""Importance resampling, sharding and whitening against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import importance, sharding, whitening
from meridia.llm.common import repeated
from meridia.llm.importance import Features

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, weight string, rank string"


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def grams_of(text, low, high):
    words = words_of(text)
    return [" ".join(words[i : i + k]) for k in range(low, high + 1) for i in range(len(words) - k + 1)]


def brute_importance(rows, target, low=1, high=1, buckets=10_000, percent=10, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, text in rows for g in grams_of(text, low, high))
    t = Counter(bucket(g) for text in target for g in grams_of(text, low, high))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for ident, text in rows:
        grams = grams_of(text, low, high)
        weight = sum(gain(bucket(g)) for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"2024:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        out.append((ident, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= least))
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    ranks = {}
    for i, x in enumerate(fit[: len(fit) * percent // 100]):
        ranks.setdefault(x, []).append(i + 1)
    return sorted((*x[:4], ranks[x].pop(0) if ranks.get(x) else None) for x in out) if all(x[0] is not None for x in out) else Counter((*x[:4],) for x in out)


@pytest.fixture(scope="module")
def corpus(odd_texts):
    rnd = random.Random(3)
    pool = [f"{a}{b}" for a in "abcdé" for b in "xyzß"] + ["The", "ÀB", "9z", "中文"]
    texts = odd_texts + [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 90))) + rnd.choice([".", "\n", "-Q"]) for _ in range(150)]
    return [(i * 7 % 161, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent", [10, 50])
def test_importance(spark, corpus, percent):
    target = ["ax ay ax, az the THE", "中文 ax", None, ""]
    docs = spark.createDataFrame([(i, t, "w", "r") for i, t in corpus], SCHEMA).repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    features = Features()
    gains = importance.gains_of(importance.bucket_counts(docs, features), importance.bucket_counts(bench, features))
    scored = importance.weighted(docs.select("doc_id", "text", "weight"), gains, features).withColumn("score", importance.score(F.col("weight"), F.col("doc_id"), 2024))
    got = importance.drawn(scored.drop("text"), percent, 20)
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()) == brute_importance(corpus, target, percent=percent)
    if percent == 10:
        assert sorted(map(tuple, importance.op11_importance(docs, bench).collect())) == brute_importance(corpus, target)
    texts = importance.resample(docs, bench, percent=percent)
    assert {r.doc_id for r in texts.collect()} == {r.doc_id for r in got.collect() if r.rank} and set(docs.columns) <= set(texts.columns)


def test_runs_of_words_stay_within_texts_and_blocks(spark, corpus, monkeypatch):
    """Runs of one to three words, with blocks of a few texts and of one."""
    texts = [t for _, t in corpus] + ["one", "two", "one two", ""]
    features = Features(1, 3, 977)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = importance.bucket_counts(docs, features)
    want = Counter(zlib.crc32(g.encode()) % 977 for t in texts for g in grams_of(t, 1, 3))
    assert {i: int(x) for i, x in enumerate(counts) if x} == want
    for block in (1, 300):
        monkeypatch.setattr(importance, "BLOCK", block)
        parts = list(importance._blocks(__import__("pyarrow").array(texts)))
        assert [x.decode() for p in parts for x in p] == [t or "" for t in texts]
        total = Counter()
        for p in parts:
            for found in importance.tuples_of(p, features)[1]:
                total.update(found.buckets[found.at].tolist())
        assert total == want
    with pytest.raises(ValueError):
        Features(2, 1)


def test_importance_of_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    long = "word " * 30
    docs = spark.createDataFrame([(None, long, "", "")] * 40 + [(4, long, "", "")] * 40 + [(4, "short", "", ""), (None, None, "", "")], SCHEMA)
    assert importance.op11_importance(none, docs.select("text")).count() == 0 and importance.resample(none, docs).count() == 0
    rows = importance.op11_importance(docs, none.select("text")).collect()
    assert len(rows) == 82 and sorted(r.rank for r in rows if r.rank) == list(range(1, 9))
    assert Counter(tuple(r)[:4] for r in rows) == brute_importance([(r.doc_id, r.text) for r in docs.collect()], [])


def test_repeated(spark):
    frame = spark.createDataFrame([("a", 3), ("b", 25_001), ("c", 0)], "k string, n long")
    got = repeated(frame, "n", "i").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("low"), F.max("i").alias("high"), F.countDistinct("i").alias("d"))
    assert {tuple(r) for r in got.collect()} == {("a", 3, 0, 2, 3), ("b", 25_001, 0, 25_000, 25_001)}


@pytest.mark.parametrize("name", ["op11_importance", "op12_sharding"])
def test_same_as_sql(spark, name):
    from meridia.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries()[name](spark, SF), con.sql(oracle_sql()[name])
    assert sorted(map(tuple, got.collect())) == sorted(want.select(*got.columns).fetchall())


def brute_shard(key, shards):
    cost = lambda s: -math.log((int(hashlib.md5(f"{s}:{'' if key is None else key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / shards[s]
    return min((s for s in shards if shards[s]), key=lambda s: (cost(s), s))


def test_sharding(docs_of, odd_texts):
    texts = odd_texts + [f"text {i % 40}" for i in range(400)]
    ids = [None, None, 5, 5, 5] + list(range(len(texts) - 5))
    docs = docs_of(texts, ids=ids)
    rows = sharding.op12_sharding(docs).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), brute_shard(i, sharding.QUERY_SHARDS), brute_shard(i, sharding.QUERY_GROWN)) for i, t in zip(ids, texts, strict=True))
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows) == want
    assert all(r.grown_shard in (r.shard, 16) and r.law == "key" for r in rows)
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.op12_sharding(docs_of([])).count() == 0


def test_slots_of_hot_rows_and_small_ranges(spark):
    """A third of all rows equal, a third of one key; ranges of four rows give the same slots as one range."""
    rows = [(1, 1, 1, 0, 3)] * 300 + [(1, i, i, 0, i) for i in range(300)] + [(i, 1, 1, i % 3, i) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, size long, text_crc32 long, shard int, p long").groupBy("doc_id", "size", "text_crc32", "shard", "p").agg(F.count("*").alias("times"))
    frame = frame.withColumn("place", sharding.place(F.concat_ws(":", "doc_id", "size", "text_crc32")))
    columns = ["doc_id", "size", "text_crc32", "shard"]
    small, large = (sorted(map(tuple, sharding.with_slots(frame, columns, n).collect())) for n in (4, 10_000))
    assert small == large and len(small) == 900
    for s in range(3):
        assert sorted(r[4] for r in small if r[3] == s) == list(range(sum(r[3] == s for r in small)))


def test_shares_follow_weights_and_few_move(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = {0: 1.0, 1: 2.0, 2: 1.0, 3: 0.0}
    share = {r.shard: r["count"] / 20_000 for r in sharding.assign(keys, before).groupBy("shard").count().collect()}
    assert set(share) == {0, 1, 2} and abs(share[1] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02
    grown = {(r.from_shard, r.to_shard): r.n_rows for r in sharding.moves(keys, before, before | {4: 1.0}).collect()}
    assert all(a == b or b == 4 for a, b in grown) and abs(sum(n for (a, b), n in grown.items() if a != b) / 20_000 - 0.2) < 0.02
    gone = sharding.moves(keys, before, {0: 1.0, 2: 1.0}).collect()
    assert all(r.from_shard in (r.to_shard, 1) for r in gone)
    heavier = sharding.moves(keys, before, before | {2: 3.0}).collect()
    assert all(r.from_shard == r.to_shard or r.to_shard == 2 for r in heavier)
    with pytest.raises(ValueError):
        sharding.assign(keys, {0: 0.0})


def test_written_shards(spark, docs_of, odd_texts, tmp_path):
    docs = docs_of(odd_texts * 3).withColumn("shard", F.lit("clash"))
    sharding.write_shards(docs, str(tmp_path / "out"), {0: 1.0, 1: 1.0}, parts=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.shard) for r in back.collect()) == Counter((i, t, brute_shard(i, {0: 1, 1: 1})) for i, t in enumerate(odd_texts * 3))


def test_remaindering():
    rnd = random.Random(5)
    for bits in (10, 60, 200):
        want = [rnd.randrange(-(2**bits), 2**bits) for _ in range(50)] + [2**bits, -(2**bits), 0]
        moduli = whitening.primes_for(1, 2 ** (bits // 2 + 1))
        assert math.prod(moduli) > 2 ** (bits + 1)
        residues = np.array([[x % p for x in want] for p in moduli])
        assert whitening.remaindered(residues, moduli).tolist() == want
    assert whitening.primes(3) == [1048573, 1048571, 1048559]


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, deviation string, vector string, key int").repartition(3)


def exact(rows):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = np.array([[float(Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    return np.array(x, object), n, s, cov


@pytest.mark.parametrize(("n", "d", "scale"), [(60, 5, 1.0), (90, 40, 0.3), (30, 4, 1e12)])
def test_whitening(spark, n, d, scale):
    rnd = np.random.default_rng(n)
    kept = (rnd.normal(size=(n, d)) @ rnd.normal(size=(d, d)) * scale).astype(np.float32)
    bad = [None, [None] * d, [float("nan")] + [0.0] * (d - 1), [float("-inf")] * d]
    rows = [(i, v, "clash", "clash", 1) for i, v in enumerate(kept.tolist())] + [(900 + i, v, "", "", 1) for i, v in enumerate(bad)]
    got = whitening.op13_whitening(vectors(spark, rows)).collect()
    x, n_, s, cov = exact(kept.tolist())
    values, axes = np.linalg.eigh(cov)
    first = np.argsort(-values)[: min(d, 32)]
    assert len(got) == n * len(first) and {r.n for r in got} == {n_} and {r.component for r in got} == set(range(1, len(first) + 1))
    want = np.array([[float(Fraction(int(v)) - Fraction(t, n)) for v, t in zip(row, s, strict=True)] for row in x]) @ axes[:, first] / np.sqrt(values[first])
    table = np.zeros_like(want)
    for r in got:
        table[r.vec_id, r.component - 1] = r.whitened
        exact_deviation = sum((n * int(v) - t) ** 2 for v, t in zip(x[r.vec_id], s, strict=True))
        assert r.deviation == (exact_deviation if exact_deviation < 2**63 else None)
        assert math.isclose(r.explained, values[first][r.component - 1] / np.trace(cov), rel_tol=1e-9) and 0 <= r.identity_error < 1e-8
    signs = np.sign((table * want).sum(axis=0))
    assert np.allclose(table * signs, want, atol=1e-6)


def test_scatter_is_the_same_for_any_partitioning(spark):
    rnd = np.random.default_rng(1)
    frame = spark.createDataFrame([(v,) for v in (rnd.normal(size=(300, 6)) * 1e9).tolist()], "vector array<double>")
    moduli = whitening.primes_for(300, 10**12)
    one, many = (whitening.scatter(frame.repartition(k), 6, moduli) for k in (1, 7))
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r.vector] + [1] for r in frame.collect()], object)
    assert (one == many).all() and (one == x.T @ x).all()


def test_whitening_of_odd_tables(spark):
    assert whitening.op13_whitening(vectors(spark, [])).count() == 0
    assert whitening.op13_whitening(vectors(spark, [(1, [], "", "", 1), (2, None, "", "", 1)])).count() == 0
    flat = whitening.op13_whitening(vectors(spark, [(None, [1.0, 2.0, 3.0], "", "", 1)] * 3 + [(7, [1.0, 4.0, 3.0], "", "", 1)])).collect()
    assert len(flat) == 12 and {r.component for r in flat if r.whitened is not None} == {1} and all(r.explained == (r.component == 1) for r in flat)
    assert sorted({(r.vec_id or 0, r.deviation) for r in flat}) == [(0, 128**2), (7, (3 * 128) ** 2)] and all(r.identity_error < 1e-12 for r in flat)
    with pytest.raises(ValueError):
        whitening.op13_whitening(vectors(spark, [(1, [1.0], "", "", 1), (2, [1.0, 2.0], "", "", 1)]))
    with pytest.raises(ValueError):
        whitening.op13_whitening(vectors(spark, [(1, [3e38], "", "", 1)]))
