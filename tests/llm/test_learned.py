"""Language identification and toxicity: held-out accuracy and edge cases."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from meridia.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    got = langid.op5_language_id(docs).join(docs.select("doc_id", "lang"), "doc_id")
    counts = langid.accuracy(got)
    assert sum(counts.values()) > 250
    assert sum(n for (a, b), n in counts.items() if a == b) / sum(counts.values()) > 0.95
    for r in got.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1


def test_language_edges(docs_of, odd_texts):
    train = docs_of(["the cat and the dog", "der hund und die katze", None, "x"], ["en", "de", "en", None])
    model = langid.fit(train)
    assert model.languages == ("de", "en")
    got = {r.doc_id: r for r in langid.predict(docs_of([*odd_texts, "katzen und hunde", "the dogs"]), model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[0].score == 0
    assert got[len(odd_texts)].lang_pred == "de" and got[len(odd_texts) + 1].lang_pred == "en"
    none = langid.fit(train.filter(F.lit(False)))
    assert [r.lang_pred for r in langid.predict(train, none).collect()] == ["und"] * 4
    kept = langid.keep_known(docs_of(odd_texts), model)
    assert kept.columns == docs_of([]).columns and kept.filter("text IS NULL OR trim(text) = ''").count() == 0


def test_backoff_gets_shorter():
    model = langid.Model(("a", "b"), {"known": (-0.1, -3.0)}, {"x": (-2.0, -0.2), "kno": (-0.3, -1.5)})
    scorer = langid.Scorer(model)
    assert scorer.predict("known")[0] == "a"
    assert scorer.unseen("knows") == pytest.approx([-0.3, -1.5])
    assert scorer.unseen("xyz") == pytest.approx([-2.0, -0.2])
    assert scorer.unseen("ü") == pytest.approx([-0.693147, -0.693147], abs=1e-5)


def test_toxicity_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.op1_toxicity(docs.select("doc_id", "text"), labels)
    rows = got.join(labels, "doc_id").filter("held_out AND toxic IS NOT NULL").groupBy("toxic", "predicted").count().collect()
    counts = {(r.toxic, r.predicted): r["count"] for r in rows}
    right = counts.get((0, 0), 0) + counts.get((1, 1), 0)
    assert right / sum(counts.values()) > 0.98
    assert counts[(1, 1)] / (counts[(1, 1)] + counts.get((1, 0), 0)) > 0.9


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_equals_distance():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(4, 10))) for _ in range(25)]
    terms = [toxicity.Term(w, 1.0 + i / 100, stem=i % 5 == 0) for i, w in enumerate(dict.fromkeys(words))]
    automaton = toxicity.LexiconAutomaton(terms, most_states=40)
    for _ in range(3000):
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 11)))
        fits = []
        for i, t in enumerate(terms):
            e = 0 if t.stem and word.startswith(t.text) else distance(word, t.text)
            if e <= t.edits:
                fits.append((e, -t.weight, i))
        assert automaton.match(word) == ((min(fits)[2], min(fits)[0]) if fits else None)


def test_context():
    scorer = toxicity.Scorer(toxicity.Model((toxicity.Term("moron", 5.0),), (-3.0, 2.0, 1.0, 0.5, 0.0)))
    plain, quoted, said, you, wrong = (scorer.score(x) for x in ("what a moron here", 'the word "moron" here', "he said moron here", "you moron here", "what a morun here"))
    assert quoted < plain < you and said < plain and wrong < plain
    assert scorer.score("") == scorer.score("nothing at all") < wrong


def test_toxicity_edges(docs_of, odd_texts):
    spark = docs_of([]).sparkSession
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    docs = docs_of(odd_texts)
    rows = toxicity.op1_toxicity(docs, labels).collect()
    assert len(rows) == len(odd_texts) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.op1_toxicity(docs.filter(F.lit(False)), labels).count() == 0
    empty = toxicity.op1_toxicity(docs, labels.filter(F.lit(False))).collect()
    assert {r.predicted for r in empty} == {0}
