"""Bounds of fitted models hold at every size; results against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_learned import distance

from meridia.llm import bpe, langid, media, minhash, pii, toxicity, url_filter


@pytest.mark.parametrize("rows", [10, 10**6, 10**11, 10**17])
def test_a_sample_is_never_empty_for_want_of_digits(rows):
    share = langid.threshold(5_000, rows) / 2**63
    assert share == pytest.approx(min(1, 5_000 / rows), rel=1e-3)


def test_every_language_is_sampled(spark):
    """One of 4,000 rows is in a rare language; it is learned though others fill the sample."""
    rows = [(i, f"common{i % 7} word text", "en") for i in range(4000)] + [(9999, "rara avis verba", "la")]
    limits = langid.Limits(sample_rows=100, most_words=50)
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), limits=limits)
    assert model.languages == ("en", "la")
    assert langid.Scorer(model).predict("rara verba")[0] == "la"
    sample = langid.sample_by_language(spark.createDataFrame(rows, "k long, t string, lang string"), limits)
    n = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert n["la"] == 1 and 50 < n["en"] < 170
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame([(i, "t", f"l{i}") for i in range(5)], "doc_id long, text string, lang string"), limits=langid.Limits(most_languages=4))


def brute_language(model_words, languages, text, longest=5, floor=-7.0):
    """Log posteriors from counts of words, with plain dictionaries."""

    def post(counts):
        total = {a: sum(c.get(a, 0) for c in counts.values()) + 0.5 * max(1, len(counts)) for a in languages}
        out = {}
        for item, c in counts.items():
            v = [math.log(c.get(a, 0) + 0.5) - math.log(total[a]) for a in languages]
            norm = math.log(sum(math.exp(x) for x in v))
            out[item] = [max(floor, x - norm) for x in v]
        return out

    grams = {}
    for word, c in model_words.items():
        for n in range(1, longest + 1):
            marked = word if n == 1 else f"<{word}>"
            for i in range(len(marked) - n + 1):
                of = grams.setdefault(marked[i : i + n], {})
                for a, k in c.items():
                    of[a] = of.get(a, 0) + math.log1p(k)
    known, parts = post({w: c for w, c in model_words.items() if sum(c.values()) >= 2}), post(grams)
    total, words = [0.0] * len(languages), re.findall(r"[^\W\d_]+", text.lower())
    for word in words:
        v = known.get(word)
        for n in range(longest, 0, -1):
            if v is None:
                marked = word if n == 1 else f"<{word}>"
                found = [parts[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in parts]
                v = [sum(x) / len(found) for x in zip(*found, strict=True)] if found else None
        v = v or [-math.log(len(languages))] * len(languages)
        total = [a + b for a, b in zip(total, v, strict=True)]
    mean = [x / len(words) * min(len(words), 20) for x in total]
    p = [math.exp(x - max(mean)) for x in mean]
    best = max(range(len(p)), key=lambda i: (p[i], -i))
    return languages[best], p[best] / sum(p)


def test_language_equals_brute_force(docs_of):
    rnd = random.Random(12)
    syllables = {"en": "the and ing ou th er".split(), "de": "sch ein ung der ich au".split(), "fr": "eau que les on ai re".split()}
    texts, langs = [], []
    for _ in range(150):
        lang = rnd.choice(sorted(syllables))
        texts.append(" ".join("".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(1, 30))))
        langs.append(lang)
    docs = docs_of(texts, langs)
    got = {r.doc_id: r for r in langid.op5_language_id(docs).collect()}
    counts = {}
    for i, (t, lang) in enumerate(zip(texts, langs, strict=True)):
        if not got[i].held_out:
            for w in t.split():
                counts.setdefault(w, Counter())[lang] += 1
    for i, t in enumerate(texts):
        lang, score = brute_language(counts, sorted(syllables), t)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-4)


def test_toxicity_equals_brute_force(docs_of):
    """Scores of the query's own path, with edit distances to every term in place of the automaton."""
    terms = (toxicity.Term("moron", 4.0), toxicity.Term("scumbag", 3.0), toxicity.Term("vermin", 2.0, stem=True), toxicity.Term("zug", 1.5), toxicity.Term("degenerate", 2.5))
    model = toxicity.Model(terms, (-3.0, 2.0, 1.0, 0.5, -0.5))
    rnd = random.Random(13)
    parts = ["moron", "Morun", "scumbags", "scmbag", "verminous", "vermxn", "zug", "zag", "degenrates", "you", "said", "the", "a", '"', "“", "”", "house", ",", "."]
    texts = [None, "", *(" ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(300))]

    def features(text):
        words = list(toxicity.WORD.finditer(text))
        exact = fuzzy = most = 0.0
        n = distanced = 0
        for i, m in enumerate(words):
            word, fits = m[0].lower(), []
            for k, t in enumerate(terms):
                e = 0 if t.stem and word.startswith(t.text) and word != t.text else distance(word, t.text)
                if e <= t.edits:
                    fits.append((e, -t.weight, k))
            if not fits:
                continue
            e, _, k = min(fits)
            before, after = words[max(0, i - 6) : i], words[i + 1 : i + 7]
            left, right = text[(before or [m])[0].start() : m.start()], text[m.end() : (after or [m])[-1].end()]
            near = {w[0].lower() for w in [*before, m, *after]}
            odd = any(left.count(q) % 2 == 1 and q in right for q in "\"“„«‹")
            tight = m.start() > 0 and text[m.start() - 1] in toxicity.QUOTES and text[m.end() : m.end() + 1] in toxicity.QUOTES
            quoted = odd or tight or any(a in left and z in right for a, z in ("“”", "„“", "«»", "‹›"))
            factor = (0.4 if quoted else 1) * (0.6 if near & toxicity.REPORTING else 1) * (1.25 if near & toxicity.SECOND else 1)
            value = terms[k].weight * factor * 0.5**e
            exact, fuzzy = (exact + value, fuzzy) if e == 0 else (exact, fuzzy + value)
            most, n, distanced = max(most, value if e == 0 else 0), n + 1, distanced + (factor < 1)
        return [1.0, math.log1p(exact), math.log1p(fuzzy), most, distanced / max(1, n)]

    for r in toxicity.score(docs_of(texts), model).collect():
        z = float(np.dot(model.weights, features(texts[r.doc_id] or "")))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_lexicon_is_not_cut(spark):
    rows = [(" ".join(f"bad{i}x{k}" for k in range(300)), 1) for i in range(9) for _ in range(20)] + [(f"good{i}", 0) for i in range(180)]
    terms = toxicity.learn_lexicon(spark.createDataFrame(rows, "t string, toxic int"))
    assert sum(not t.stem for t in terms) == 2700


def test_lexicon_leaves_chance_out(spark):
    """Words that fall on rows at random are no terms, one that marks toxic rows is."""
    rnd = random.Random(18)
    rows = [(" ".join(f"word{rnd.randrange(3000)}" for _ in range(40)) + (" vile" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    terms = toxicity.learn_lexicon(spark.createDataFrame(rows, "t string, toxic int"))
    assert "vile" in {t.text for t in terms} and len(terms) <= 3


def test_one_rule_for_small_and_large_buckets(docs_of):
    """The same texts get the same classes whether buckets give pairs or blocks."""
    rnd = random.Random(14)
    base = [f"w{rnd.randint(0, 500)}" for _ in range(120)]
    texts = []
    for _ in range(70):
        words = list(base)
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(120)] += "x"
        texts.append(" ".join(words))
    docs = docs_of(texts)
    found = [sorted((r.doc_id, r.class_id) for r in minhash.classes(docs, minhash.Settings(small_bucket=n, block=16)).collect()) for n in (1000, 2)]
    assert found[0] == found[1]


def test_texts_do_not_travel_to_all_blocks(docs_of, monkeypatch):
    """What is grouped by block first has signatures, no words."""
    plans = []
    kept = minhash.written
    monkeypatch.setattr(minhash, "written", lambda frame, name="table": plans.append((name, frame._jdf.queryExecution().analyzed().toString())) or kept(frame, name))
    rnd = random.Random(15)
    texts = [" ".join(f"w{i}" + "x" * (rnd.random() < 0.03) for i in range(100)) for _ in range(40)]
    minhash.classes(docs_of(texts), minhash.Settings(small_bucket=3, block=8)).count()
    blocks = [p for name, p in plans if name == "candidates"]
    assert blocks and all("words" not in p for p in blocks)


def test_coreference_across_formats(spark):
    groups = [
        ["+1 (286) 555-5053", "+1-286-555-5053", "+12865555053"],
        ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"],
        ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"],
        ["ana@mail.com", "Ana@Mail.com", "ANA@mail.com"],
    ]
    names = ["Anna Müller", "Frau Müller", "Herr MÜLLER", "Dr. Anna Müller"]
    rows = [(x,) for g in groups for x in g] + [(x,) for x in names]
    given = {r.entity: r.surrogate for r in pii.assign(spark.createDataFrame(rows, "entity string"), "key").collect()}
    for g in groups:
        assert len({re.sub("[ ()-]", "", given[x]).lower() for x in g}) == 1
        assert all(re.sub(r"\w", "x", given[x]) == re.sub(r"\w", "x", x) for x in g)
    assert len({given[x].split()[-1].lower() for x in names}) == 1
    compact = given["DE89370400440532013000"]
    assert int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def test_surrogates_look_unlike_their_entities(spark):
    rnd = random.Random(16)
    names = [f"Dr {a}{b}{c}" for a in ("Sm", "Kl", "Br", "Tr") for b in ("i", "oo", "ei") for c in ("th", "mann", "d", "nsky")]
    phones = [f"+1 {rnd.randint(200, 999)} {rnd.randint(200, 999)} {rnd.randint(1000, 9999)}" for _ in range(300)]
    given = pii.assign(spark.createDataFrame([(x,) for x in {*names, *phones}], "entity string"), "key").collect()
    for r in given:
        old, new = (re.sub(r"^Dr |^\+1|\W", "", x) for x in (r.entity, r.surrogate))
        assert sum(a == b for a, b in zip(old, new, strict=False)) <= len(old) / 4 and old != new


def test_first_names_stay_in_their_lists(spark):
    names = [(n, k) for k, v in pii.FIRST_NAMES.items() for n in v]
    found = spark.createDataFrame([(f"{n} Zzyzx",) for n, _ in names], "entity string").select("entity", pii.surrogate(F.col("entity"), F.lit("key|0")).alias("s"))
    given = {r.entity.split()[0]: r.s.split()[0] for r in found.collect()}
    assert all(given[n] in pii.FIRST_NAMES[k] and given[n] != n for n, k in names)
    assert len(set(given.values())) == len(given)


RECALL = ["Juan Pérez", "Priya Patel", "Mohammed Khan", "Wei Zhang", "Dear Piotr Nowak", "my name is Oluwaseun Adeyemi", "Dr. Li Xiang", "je m'appelle Zoé Dupont", "Herr Schmidt", "Иван Петров"]


def test_names_are_found(spark):
    rows = spark.createDataFrame([(f"yesterday {x}, it was",) for x in RECALL] + [(x,) for x in ("Dear Customer, hello", "the Dear Sir or Madam", "New York is big", "He said Dear me")], "t string")
    found = [r[0] for r in rows.select(pii.entities("t")).collect()]
    assert all(len(x) == 1 for x in found[: len(RECALL)]) and not any(found[len(RECALL) :])


def test_pii_changes_entities_alone(spark):
    """What stands between entities stays, entities are mapped one to one, the same everywhere."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    both = docs.withColumnRenamed("text", "old").join(pii.op8_pii(docs), "doc_id").select("old", "text", F.split("old", pii.ENTITY, -1).alias("pieces"), pii.entities("old").alias("found")).collect()
    mapped = {}
    for r in both:
        if r.old is None:
            assert r.text is None
            continue
        at = 0
        for i, piece in enumerate(r.pieces):
            assert r.text.startswith(piece, at)
            at += len(piece)
            if i < len(r.found):
                rest = r.text[at:]
                end = rest.index(r.pieces[i + 1]) if r.pieces[i + 1] else len(mapped.get(r.found[i], r.found[i]))
                new = rest[:end]
                assert mapped.setdefault(r.found[i], new) == new != r.found[i]
                at += end
        assert at == len(r.text)
    assert len(set(mapped.values())) == len(mapped) > 10 and not set(mapped) & set(mapped.values())


def test_pii_edges(docs_of, odd_texts):
    docs = docs_of([*odd_texts, "ana@mail.com", "ana@mail.com", "+1 286 555 5053 " * 3000], ids=[1] * 5 + [None] * 4 + [1, None, 3])
    clashing = docs.selectExpr("*", "'x' AS _pii_found", "'y' AS _pii_moved", "'z' AS _pii_id")
    rows = pii.replace(clashing, "key").collect()
    assert len(rows) == len(odd_texts) + 3 and {(r._pii_found, r._pii_moved, r._pii_id) for r in rows} == {("x", "y", "z")}
    long = next(r.text for r in rows if r.doc_id == 3)
    assert len(long) == 16 * 3000 and len(set(long.split(" +1"))) <= 3
    assert len({r.text for r in rows if r.text and r.text.endswith(".com")}) == 1
    assert pii.op8_pii(docs.filter(F.lit(False))).count() == 0


def test_media_columns_equal_brute_force(docs_of, odd_texts):
    """BMP, tiles and features of the stored payload, computed plainly."""
    for r in media.op10_media_columns(docs_of(odd_texts)).collect():
        raw = (odd_texts[r.doc_id] or "").encode()
        rows = np.frombuffer(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), np.uint8).reshape(-1, 64)
        assert r.bmp_sha256 == hashlib.sha256(media.encode_grey_bmp(rows)).hexdigest()
        assert (media.decode_bmp(media.encode_grey_bmp(rows))[:, :, 1] == rows).all()
        digest, n = hashlib.sha256(), 0
        for y in range(0, len(rows), 64):
            tile = rows[y : y + 64]
            head = f"{{'descr': '|u1', 'fortran_order': False, 'shape': {tile.shape}, }}"
            head = head.ljust(128 - 10 - 1) + "\n"
            digest.update(b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head.encode() + tile.tobytes())
            n += 1
        assert (r.n_tiles, r.tiles_sha256) == (n, digest.hexdigest())
        k = len(rows)
        cells = np.kron(rows.astype(float), np.ones((8, 9))).reshape(8, k, 9, 64).mean(axis=(1, 3))
        assert r.feature.split(":")[0] == np.packbits(cells[:, :-1] + 1e-6 < cells[:, 1:]).tobytes().hex()


def test_broken_images_are_null(spark):
    huge = [b"P5\n99999999999999999999 99999999999999999999\n255\nx", b"P4\n99999999999999999999 9\nx", b"P1\n" + b"9" * 5000 + b" 1\n1", b"BM" + bytes(60), b"P5\n0 0\n255\n"]
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(huge)], "k long, image binary")
    assert [(r.k, r.tile) for r in media.decode_column(rows, key="k", image="image").orderBy("k").collect()] == [(i, None) for i in range(len(huge))]


def test_offsets_equal_the_library(docs_of):
    rnd = random.Random(17)
    parts = [" ", "a", " the", "é", "日本", "🙂", "\n", "½", " naïve", "123"]
    coder = bpe.byte_bpe()
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 15)))
        assert [tuple(x) for x in coder.offsets(text).tolist()] == coder.tokenizer.encode(text, add_special_tokens=False).offsets
    row = bpe.op6_byte_bpe(docs_of(["né🙂"])).first()
    assert row.offsets_sha256 == hashlib.sha256(np.array(coder.offsets("né🙂"), "<i4").tobytes()).hexdigest()


def test_hubs_and_convergence(spark):
    """A hub's edges are dealt to parts without changing a score, and ranks rest."""
    edges = [("trust", "hub", f"h{i}", 1.0) for i in range(50)] + [("trust", f"h{i}", "hub", 2.0) for i in range(50)]
    frame = spark.createDataFrame(edges, "kind string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("trust", "hub", 1.0)], "kind string, host string, mass double")
    got = {n: {r.host: r.score for r in url_filter.propagate(frame, seeds, hub=n, tolerance=1e-9, rounds=200).collect()} for n in (7, 1000)}
    assert got[7] == pytest.approx(got[1000])
    hub = 0.15 / (1 - 0.85**2)  # what leaves the hub comes back after two steps
    assert got[7]["hub"] == pytest.approx(hub, abs=1e-6) and got[7]["h3"] == pytest.approx(0.85 * hub / 50, abs=1e-6)


def test_long_html_is_linear(spark):
    pages = spark.createDataFrame([(0, "http://a.net/" + "x" * 100_000, "<a " * 200_000)], "page_id long, url string, html string")
    assert url_filter.op2_url_filters(pages).first().host == "a.net"


def bit_field_bmp(pixels, depth, masks=None):
    """A BMP of rows of numbers, top row last, with masks after its header if they are given."""
    import struct

    width, stride = len(pixels[0]), (len(pixels[0]) * depth + 31) // 32 * 4
    rows = b"".join(struct.pack(f"<{width}{'H' if depth == 16 else 'I'}", *r).ljust(stride, b"\0") for r in reversed(pixels))
    extra = struct.pack("<III", *masks) if masks else b""
    head = struct.pack("<2sIHHI", b"BM", 54 + len(extra) + len(rows), 0, 0, 54 + len(extra))
    return head + struct.pack("<IiiHHIIiiII", 40, width, len(pixels), 1, depth, 3 if masks else 0, len(rows), 0, 0, 0, 0) + extra + rows


def test_bit_fields_of_bmp():
    from meridia.llm import media

    swapped = bit_field_bmp([[0x000000FF, 0x0000FF00, 0x00FF0000]], 32, (0x000000FF, 0x0000FF00, 0x00FF0000))
    assert media.decode(swapped).tolist() == [[[255, 0, 0], [0, 255, 0], [0, 0, 255]]]
    usual = bit_field_bmp([[0x000000FF], [0x00FF0000]], 32, (0x00FF0000, 0x0000FF00, 0x000000FF))
    assert media.decode(usual).tolist() == [[[0, 0, 255]], [[255, 0, 0]]]
    five_six = bit_field_bmp([[0xF800, 0x07E0, 0x001F, 0xFFFF, 0x8000]], 16, (0xF800, 0x07E0, 0x001F))
    assert media.decode(five_six).tolist() == [[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255], [132, 0, 0]]]
    assert media.decode(bit_field_bmp([[0x7C00, 0x03E0, 0x001F]], 16)).tolist() == [[[255, 0, 0], [0, 255, 0], [0, 0, 255]]]
    assert media.decode(bit_field_bmp([[0x3FF00000]], 32, (0x3FF00000, 0, 0))).tolist() == [[[255, 0, 0]]]
    for bad in (bit_field_bmp([[1]], 32, (5, 0, 0)), bit_field_bmp([[1]], 32, (1, 0, 0))[:54]):
        try:
            media.decode(bad)
        except (ValueError, __import__("struct").error):
            continue
        raise AssertionError("decoded")
