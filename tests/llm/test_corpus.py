"""Near duplicates, PII, mixing and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meridia.llm import minhash, mixing, pii

SF = "/root/testdata/sf0.001"


def shingle_bag(text):
    words = [w for w in re.split("[ \t-\r]+", (text or "").lower()) if w]
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_classes(rows):
    """Smallest id of each component, all pairs compared."""
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    bags = [(i, t or "", shingle_bag(t)) for i, t in rows]
    for k, (i, t, a) in enumerate(bags):
        for j, u, b in bags[:k]:
            shared = sum((a & b).values())
            total = sum(a.values()) + sum(b.values()) - shared
            if t == u or shared and shared / total >= 0.8:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def near_copies(rnd, n, most_edits):
    base = [rnd.choice("the of and to in is it that was for on are with as his they at be this from".split()) + str(rnd.randint(0, 99)) for _ in range(150)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randint(0, most_edits)):
            words[rnd.randrange(len(words))] += rnd.choice("xyz")
        out.append(" ".join(words))
    return out


def classes_of(frame):
    return {r.doc_id: r.class_id for r in frame.collect()}


def test_classes_equal_brute_force(spark, docs_of, odd_texts):
    rnd = random.Random(6)
    texts = odd_texts + near_copies(rnd, 120, 9) + near_copies(rnd, 40, 3) + ["short text", "Short  TEXT", "short text!"]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    assert classes_of(minhash.op3_near_dedup(docs_of(texts))) == brute_classes(rows)


def test_large_buckets_are_dealt_to_blocks(docs_of):
    """Families of several blocks give the same classes as all pairs."""
    rnd = random.Random(7)
    texts = near_copies(rnd, 90, 14)
    settings = minhash.Settings(small_bucket=4, block=20)
    assert classes_of(minhash.op3_near_dedup(docs_of(texts), settings)) == brute_classes(list(enumerate(texts)))


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert classes_of(minhash.op3_near_dedup(docs)) == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_dedup_edges(docs_of):
    docs = docs_of(["a b c d e f", "a b c d e f", "q r s", "q r s", None, ""], ids=[4, 4, None, 2, 7, 9])
    rows = [(r.doc_id, r.class_id) for r in minhash.op3_near_dedup(docs).collect()]
    assert sorted(rows, key=str) == sorted([(4, 4), (None, None), (2, 2), (7, 7), (9, 7)], key=str)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([4, None, 2, 7], key=str)
    assert minhash.op3_near_dedup(docs.filter(F.lit(False))).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(8)
    for most in (2, 9, 70):
        items = rng.integers(0, 2**63, 40).astype(np.uint64)
        a = rng.integers(0, most, 40)
        b = np.maximum(0, a + rng.integers(-most // 2, most // 2 + 1, 40))
        doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        sig = minhash.signatures(doc, np.concatenate([items[a > 0], items[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 20_000)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert (sig[0] == sig[1]).mean() == pytest.approx(true, abs=0.015)


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    up = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.id: r.label for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: y for x, y in up.items() if any(x in e and e[0] != e[1] for e in edges)}


ENTITIES = {
    "email": "anna.b-7@mail3.example.com",
    "ip": "17.57.238.115",
    "phone": "+1 (286) 555-5053",
    "card": "4111 1111 1111 1111",
    "ssn": "123-45-6789",
    "iban": "DE89370400440532013000",
    "name": "Frau Anna Müller",
}


def luhn(digits):
    d = [int(x) for x in digits if x.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def shape(text):
    return re.sub(r"\d", "9", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", text))


def test_bitmaps_keep_all_members(spark):
    rows = spark.range(-3000, 3000).withColumn("text", F.lit("x"))
    ids = rows.filter("id % 7 = 0").select("id")
    kept = minhash.likely_in(rows, ids, 64)
    assert kept.columns == rows.columns
    got = {r.id for r in kept.collect()}
    assert got >= {r.id for r in ids.collect()}
    assert len(got) < 900  # 858 members, one other in 2,400
    assert minhash.likely_in(rows, ids.limit(0), 64).isEmpty()


def test_surrogates(docs_of):
    texts = [f"x {e}, and {e}. Then {e}!" for e in ENTITIES.values()] + [None, "", "plain 12.5 text 2024", "Jürgen Schmidt met Herr Schmidt"]
    got = {r.doc_id: r for r in pii.op8_pii(docs_of(texts)).collect()}
    for i, (kind, entity) in enumerate(ENTITIES.items()):
        assert {k: got[i][f"n_{k}"] for k in pii.KINDS} == {k: 3 * (k == kind) for k in pii.KINDS}
        assert entity not in got[i].text
        new = re.fullmatch(r"x (.*), and (.*)\. Then (.*)!", got[i].text).groups()
        assert len(set(new)) == 1  # the same entity, the same surrogate
        if kind not in ("ip", "name"):
            assert shape(new[0]) == shape(entity)
        if kind == "card":
            assert luhn(new[0]) and new[0][0] == "4"
        if kind == "ip":
            assert all(0 <= int(x) <= 255 for x in new[0].split("."))
        if kind == "name":
            assert new[0].split()[1] in pii.FIRST_NAMES[("de", "f")] and new[0].split()[1] != "Anna"
    n = len(ENTITIES)
    assert [got[n].text, got[n + 1].text, got[n + 2].text] == [None, "", "plain 12.5 text 2024"]
    first, second = re.fullmatch(r"(.*) met (.*)", got[n + 3].text).groups()
    assert first.split()[0] in pii.FIRST_NAMES[("de", "m")] and first.split()[1] == second.split()[1] != "Schmidt"


def test_surrogates_are_distinct(spark):
    """Two-letter surnames are so few that some surrogates are entities and get another try."""
    names = [f"Ms. {a}{b}" for a in "BCDFGH" for b in "aei"]
    numbers = [f"+1 (555) 010-{i:04d}" for i in range(3000)]
    found = spark.createDataFrame([(x,) for x in names + numbers], "entity string")
    given = pii.assign(found, "key", attempts=12)
    row = given.agg(F.countDistinct("surrogate").alias("n"), F.max("attempt").alias("again")).first()
    assert row.n == len(names) + len(numbers) and row.again > 0
    assert given.join(found.withColumnRenamed("entity", "surrogate"), "surrogate", "left_semi").count() == 0


def test_colliding_surrogates_in_texts(spark, docs_of):
    """An entity whose first surrogate is in the corpus gets another one, everywhere."""
    one = "+1 (286) 555-5053"
    taken = spark.range(1).select(pii.surrogate(F.lit(one), F.lit("key|0"))).first()[0]
    docs = docs_of([f"a {one}", f"b {one} {taken}", "c"])
    got = [r.text for r in pii.replace(docs, "key").orderBy("doc_id").collect()]
    again = got[0][2:]
    assert again not in (one, taken) and got[1].startswith(f"b {again} ") and got[2] == "c"
    assert pii.replace(docs, "key").columns == docs.columns


def fill(children, budget):
    """Shares by weight, what one can't use going to the others, again and again."""
    out, open_ = dict.fromkeys(children, 0.0), {k for k, (w, c) in children.items() if w > 0 and c > 0}
    budget = min(budget, sum(children[k][1] for k in open_))
    while open_ and budget > 1e-9:
        total = sum(children[k][0] for k in open_)
        add = {k: min(budget * children[k][0] / total, children[k][1] - out[k]) for k in open_}
        for k, v in add.items():
            out[k] += v
        budget -= sum(add.values())
        open_ = {k for k in open_ if out[k] < children[k][1] - 1e-9}
    return out


def brute_budgets(capacity, weights, target):
    w = lambda path: weights.of.get(path, 1.0)
    # what is below a weight of 0 is no capacity
    capacity = {k: c if all(w(k[:depth]) > 0 for depth in (1, 2, 3)) else 0.0 for k, c in capacity.items()}
    budgets = {(): min(target, sum(capacity.values()))}
    for depth in (1, 2, 3):
        level = defaultdict(float)
        for leaf, c in capacity.items():
            level[leaf[:depth]] += c
        for parent in {k[:-1] for k in level}:
            children = {k: (w(k), c) for k, c in level.items() if k[:-1] == parent}
            budgets |= fill(children, budgets[parent])
    return {k: v for k, v in budgets.items() if len(k) == 3}


def test_budgets(spark):
    rnd = random.Random(10)
    for _ in range(3):
        capacity = {(f"d{rnd.randrange(3)}", f"l{rnd.randrange(3)}", f"s{i}"): float(rnd.choice([0, 5, 50, 500])) for i in range(14)}
        paths = {p for leaf in capacity for p in (leaf[:1], leaf[:2], leaf)}
        weights = mixing.Weights({p: rnd.choice([0.0, 0.5, 1.0, 4.0]) for p in sorted(paths) if rnd.random() < 0.6})
        leaves = spark.createDataFrame([(*k, c) for k, c in capacity.items()], "domain string, language string, source string, capacity double")
        for target in (10.0, 300.0, 1e6):
            got = {(r.domain, r.language, r.source): r.budget for r in mixing.allocate(leaves, target, weights).collect()}
            assert got == pytest.approx(brute_budgets(capacity, weights, target), abs=1e-6)
            # all of the target is used whenever leaves that weights reach can take it
            useful = sum(c for k, c in capacity.items() if all(weights.of.get(k[:depth], 1.0) > 0 for depth in (1, 2, 3)))
            assert sum(got.values()) == pytest.approx(min(target, useful), abs=1e-6)
    plain = mixing.Weights({("d0",): 3.0})
    got = {(r.domain, r.language, r.source): r.budget for r in mixing.allocate(leaves, 120.0, plain).collect()}
    assert got == pytest.approx(brute_budgets(capacity, plain, 120.0), abs=1e-6)


def test_weight_zero_below_a_domain_loses_no_budget(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 100.0), ("d1", "en", "b", 100.0)], "domain string, language string, source string, capacity double")
    got = mixing.allocate(leaves, 100.0, mixing.Weights({("d0", "en"): 0.0})).collect()
    assert {r.domain: r.budget for r in got} == {"d0": 0.0, "d1": 100.0}


def test_mix_with_clashing_names(docs_of):
    docs = docs_of(["a b", "c d", "e f"])
    clashing = docs.selectExpr("*", "'x' AS _leaf", "'y' AS _cut", "'z' AS _place", "7 AS copies", "'d' AS domain")
    want = {r.doc_id: r.copies for r in mixing.select_mix(docs, target_share=2.0, max_epochs=2).collect()}
    rows = mixing.select_mix(clashing, target_share=2.0, max_epochs=2).collect()
    assert {r.doc_id: r.copies for r in rows} == want and {(r._leaf, r._cut, r._place) for r in rows} == {("x", "y", "z")}


def test_mix_takes_prefixes(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 7)
    rnd = random.Random(11)
    texts = [" ".join(["w"] * rnd.randint(0, 30)) for _ in range(300)] + [None, "", "x"]
    sources = [rnd.choice(["src1", "src1", "src1", "src2", "src6", None]) for _ in texts]
    langs = [rnd.choice(["en", "de", None]) for _ in texts]
    docs = docs_of(texts, langs, sources, ids=[*range(302), None])
    weights = mixing.Weights({("domain2",): 3.0, ("domain1", "en"): 0.2})
    place = {(r.doc_id, e): r[f"p{e}"] for r in docs.select("doc_id", *(mixing.position(F.lit(e), 7, F.coalesce("doc_id", F.lit(-(2**63)))).alias(f"p{e}") for e in range(4))).collect() for e in range(4)}
    for share, epochs in ((0.4, 1), (0.7, 3), (2.0, 3)):
        got = {r.doc_id: r.copies for r in mixing.select_mix(docs, weights, target_share=share, max_epochs=epochs).collect()}
        leaves = defaultdict(list)
        for i, (t, lang, s) in enumerate(zip(texts, langs, sources, strict=True)):
            domain = f"domain{int(s[3:]) % 4}" if s else ""
            leaves[(domain, lang or "", s or "")].append((None if i == 302 else i, len((t or "").split())))
        supply = {k: sum(n for _, n in v) for k, v in leaves.items()}
        budgets = brute_budgets({k: float(v * epochs) for k, v in supply.items()}, weights, share * sum(supply.values()))
        want = {}
        for leaf, members in leaves.items():
            budget = round(budgets[leaf])
            whole = min(budget // supply[leaf], epochs) if supply[leaf] else 0
            rest = budget - whole * supply[leaf]
            for i, n in sorted(members, key=lambda m: (place[(m[0], whole)], -(2**63) if m[0] is None else m[0])):
                want[i] = whole + (rest > 0)
                rest -= n
        assert got == {i: n for i, n in want.items() if n}


def test_mix_edges(docs_of):
    with pytest.raises(ValueError):
        mixing.Weights({("a",): -1.0})
    with pytest.raises(ValueError):
        mixing.select_mix(docs_of(["a"]))
    assert mixing.select_mix(docs_of(["a"]).filter(F.lit(False)), target_share=0.5).count() == 0
    assert mixing.op7_source_mix(docs_of(["a b", "c d", None])).columns == ["doc_id", "domain", "lang", "source", "copies"]


def test_native_plans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for frame in (mixing.op7_source_mix(docs), pii.op8_pii(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.limit(3).unionByName(spark.createDataFrame([(10**6, None, "en", "src1", 0), (10**6 + 1, "12 34", None, None, None)], docs.schema))
    now, sizes = docs.unionByName(more), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        if name != "byte_bpe":
            assert out.columns == list(docs.columns)
            now = spark.createDataFrame(out.collect(), docs.schema)
            sizes.append(now.count())
        else:
            assert out.count() == sizes[-1]
            assert all(len(r.ids) == r.n_tokens for r in out.collect())
    assert docs.count() + 3 >= sizes[0] > sizes[1] == sizes[2] > sizes[3] > 0  # the two odd rows go, the three repeated ones later
    assert now.select("doc_id").distinct().count() == sizes[-1]
