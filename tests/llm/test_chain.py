"""The pipeline, run as a whole, against brute force of each of its stages."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_bounds import brute_language
from test_corpus import brute_budgets, brute_classes

import corpus_pipeline
from meridia.llm import bpe, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def corpus():
    rnd = random.Random(21)
    syllables = {"en": "the and ing ou th er".split(), "de": "sch ein ung der ich au".split()}
    rows = []
    for i in range(120):
        lang = rnd.choice(sorted(syllables))
        words = ["".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 80))]
        rows.append([i, " ".join(words), rnd.choice([lang, lang, None]), f"src{rnd.randint(0, 5)}"])
    for i in range(40):
        rows.append([200 + i, rows[rnd.randrange(120)][1] + rnd.choice(["", "", " der"]), None, "src1"])
    rows += [[300, None, "en", "src1"], [301, "", "en", None], [302, "12 34", None, "src2"]]
    return [(*r, len(r[1] or ""), "x") for r in rows]


def brute(spark, rows):
    languages = sorted({r[2] for r in rows if r[2] and r[1]})
    counts = {}
    for _, text, lang, *_ in rows:
        for w in (text or "").split() if lang else ():
            counts.setdefault(w, Counter())[lang] += 1
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "") and brute_language(counts, languages, r[1])[1] >= 0.4]
    classes = brute_classes([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if classes[r[0]] == r[0]]  # none has an entity, so PII changes no text
    leaves = defaultdict(list)
    for r in kept:
        leaves[(f"domain{int(r[3][3:]) % 4}", r[2] or "", r[3])].append(r)
    supply = {k: float(sum(len(r[1].split()) for r in v)) for k, v in leaves.items()}
    budgets = brute_budgets(supply, mixing.QUERY_WEIGHTS, corpus_pipeline.TARGET_SHARE * sum(supply.values()))
    ids = spark.createDataFrame([(r[0],) for r in kept], "doc_id long")
    place = {r.doc_id: r.p for r in ids.select("doc_id", mixing.position(F.lit(0), 7, F.col("doc_id")).alias("p")).collect()}
    out = set()
    for leaf, members in leaves.items():
        rest = round(budgets[leaf])
        if rest >= supply[leaf]:
            out |= {r[0] for r in members}
            continue
        for r in sorted(members, key=lambda r: (place[r[0]], r[0])):
            if rest > 0:
                out.add(r[0])
            rest -= len(r[1].split())
    return {r[0]: r[1] for r in kept if r[0] in out}


def test_run_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = brute(spark, rows)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    assert set(got) == set(want) and 20 < len(want) < 150
    for i, text in want.items():
        ids = enc.encode_ordinary(text)
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("k", range(4))
def test_stages_return_the_columns_of_documents(spark, k):
    docs = spark.createDataFrame(corpus()[:30], SCHEMA)
    assert corpus_pipeline.STAGES[k][1](spark, docs, "").columns == ["doc_id", "text", "lang", "source", "n_chars"]
