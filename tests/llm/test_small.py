"""Quality rules, URL rules, secrets, BPE and media against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from meridia.llm import automata, bpe, media, quality, secrets, url_filter

SF = "/root/testdata/sf0.001"


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def brute_quality(text):
    text = text or ""
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(docs_of, odd_texts):
    rnd = random.Random(1)
    texts = odd_texts + ["".join(rnd.choice(["a", "b", " ", " ", "\n", "# ", "the "]) for _ in range(rnd.randint(0, 200))) for _ in range(60)]
    got = by_id(quality.op9_quality_rules(docs_of(texts)))
    for i, text in enumerate(texts):
        n, chars, symbols, lines, repeats = brute_quality(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        failed = n < 50 or 100 * repeats > 50 * n
        assert r.base_failed == failed and (not failed or not r.kept)
    assert quality.op9_quality_rules(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        quality.compile_rules((quality.Threshold("x", "n_words"),))


def test_quality_is_one_projection(spark):
    plan = quality.op9_quality_rules(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_quality_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = quality.op9_quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    want = con.sql(quality.oracle_sql()).df()[list(got.columns)]
    assert got.sort_values("doc_id").to_dict("records") == want.sort_values("doc_id").to_dict("records")


def brute_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?q=http://b.net/es/", "https://example.com/en", "x://a.example.com/en/#f", "http://notcom/fr/", "http://a.net/fr/x", "http://net/es/", "http://É.com", "http://com/", "http://b.org?x/en/", "http://www.example.com/en/y", "http://a.b.www.example.com/en/"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(URLS)], "page_id long, url string, html string, verdict string")
    for r in url_filter.op2_url_filters(pages).collect():
        host, path, rule, verdict = brute_url(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or "allow")
    assert url_filter.op2_url_filters(pages.limit(0)).count() == 0


def brute_rank(edges, seeds, rounds=12, d=0.85):
    nodes = {x for e in edges for x in e[:2]} | set(seeds)
    total, out = sum(seeds.values()), Counter()
    for a, _, w in edges:
        out[a] += w
    score = {n: seeds.get(n, 0) / total for n in nodes}
    start = dict(score)
    for _ in range(rounds):
        new = {n: (1 - d) * start[n] for n in nodes}
        for a, b, w in edges:
            new[b] += d * score[a] * w / out[a]
        score = new
    return score


def test_link_propagation(spark):
    link = lambda *hosts: "".join(f'<a class="x" HREF="https://{h}/p">t</a>' for h in hosts) + '<a href="/own">o</a>'
    pages = [(0, "http://good.com/a", link("mid.org", "good.com")), (1, "http://mid.org/x", link("far.org", "far.org", "bad.net")), (2, "http://spam.org/", link("bad.net")), (3, "http://bad.net/fr/1", None), (4, "http://far.org/", "")]
    rows = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    edges = [("good.com", "mid.org", 1), ("mid.org", "far.org", 2), ("mid.org", "bad.net", 1), ("spam.org", "bad.net", 1)]
    trust, doubt = brute_rank(edges, {"good.com": 1.0}), brute_rank([(b, a, w) for a, b, w in edges], {"bad.net": 1.0})
    for r in rows:
        assert r.trust == pytest.approx(trust.get(r.host, 0.0)) and r.distrust == pytest.approx(doubt.get(r.host, 0.0))
    assert {r.host: r.verdict for r in rows} == {"good.com": "allow", "mid.org": "allow" if trust["mid.org"] >= doubt["mid.org"] else "block", "spam.org": "block", "bad.net": "block", "far.org": "allow"}


BASE = {
    "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def brute_secrets(text):
    found = [(m.start(), k, m.end(), name) for k, (name, (p, ok)) in enumerate(BASE.items()) for m in p.finditer(text) if ok(m)]
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(found)]


def test_secrets(docs_of, odd_texts):
    rnd = random.Random(2)
    parts = ["password", "passwd", "SECRET", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "123456", "AKIA", "ABCDEFGHIJ", "0123456789abcdef", "é", "-", "\n", "a", "ſecret", "ghp_", "x" * 40]
    texts = odd_texts + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
    for i, r in by_id(secrets.op4_secret_scans(docs_of(texts))).items():
        want = brute_secrets(texts[i] or "")
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if x.split(":")[0] in BASE] == want
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k + ":") for x in want) for k in BASE)


def test_further_secrets():
    scan = secrets.scanner()
    text = "é ghp_" + "A1" * 18 + " -----BEGIN RSA PRIVATE KEY----- xoxb-123456789012-abcdef"
    kinds = [scan.rules[k].kind for _, _, k in scan.text_spans(text)]
    assert kinds == ["github", "pem", "slack"]
    assert secrets.redact(text, scan.text_spans(text)) == "é <secret> <secret> <secret>"


def test_minimal_automaton():
    """Two ways to write one language have the same smallest automaton."""
    one, two = (automata.compile_dfa([automata.parse(x)], anywhere=False) for x in ("(a|b)*abb", "(b|a)*a(bb)"))
    assert one.states == two.states == 5  # four, and the dead one
    assert automata.longest(one, b"aabbx", 0, 5) == (4, 4)


def test_bpe(docs_of, odd_texts):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "don't", "'S", " é", "日本", "\u00a0", "\u3000", "½", "🙂", "🏽", "\u0301", "$$$", " the", "\r\n", "<|endoftext|>", "\ufeff", "\x1c", "\x85", ".", ","]
    texts = odd_texts + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(1500)]
    for i, r in by_id(bpe.op6_byte_bpe(docs_of(texts))).items():
        ids = enc.encode_ordinary(texts[i] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest()


def test_bpe_offsets_and_split_characters(docs_of):
    coder = bpe.byte_bpe()
    ids = coder.encode("né🙂")
    assert len(ids) == len(coder.offsets("né🙂"))
    stream = bpe.Decoder(coder)
    assert "".join(stream.feed([x]) for x in ids) + stream.feed([], True) == "né🙂"
    docs = docs_of(["né🙂 x", None])
    encoded = bpe.encode_texts(docs, offsets=True)
    assert {r.doc_id: r.text for r in bpe.decode_ids(encoded).collect()} == {0: "né🙂 x", 1: ""}
    for r in encoded.collect():
        assert len(r.ids) == len(r.starts) == len(r.ends)
    token = next(t for t, n in bpe.read_ranks(public_tokenizers.path(bpe.RANKS)).items() if n == 1000)
    assert base64.b64encode(token) and coder.bytes_of[1000] == token


def test_media(docs_of, odd_texts):
    for i, r in by_id(media.op10_media_columns(docs_of(odd_texts))).items():
        raw = (odd_texts[i] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_image_formats(spark):
    rng = np.random.default_rng(4)
    grey, colour = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey))[:, :, 0] == grey).all()
    assert (media.decode(media.encode_bmp(colour)) == colour).all()
    assert (media.decode(b"P6 # c\n7 5 255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P2\n7 5\n255\n" + " ".join(map(str, grey.ravel())).encode())[:, :, 0] == grey).all()
    bits = (grey > 127).astype(np.uint8)
    assert (media.decode(b"P4\n7 5\n" + np.packbits(bits, axis=1).tobytes())[:, :, 0] == (1 - bits) * 255).all()
    assert (media.decode(b"P1\n7 5\n" + "".join(map(str, bits.ravel())).encode())[:, :, 0] == (1 - bits) * 255).all()
    assert (media.decode(b"P5\n7 5\n65535\n" + grey.astype(">u2").tobytes())[:, :, 0] == grey).all()
    resized = media.area_resize(grey, 2, 3)
    cells = np.kron(grey.astype(float), np.ones((2, 3))).reshape(2, 5, 3, 7).mean(axis=(1, 3))
    assert np.allclose(resized, cells)
    rows = media.decode_column(spark.createDataFrame([(0, bytearray(media.encode_pgm(grey))), (1, bytearray(b"junk")), (2, None)], "k long, image binary"), key="k", image="image", tile=4).orderBy("k", "tile_row", "tile_col").collect()
    assert [(r.k, r.tile_row, r.tile_col) for r in rows] == [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, None, None), (2, None, None)]
    assert np.load(__import__("io").BytesIO(bytes(rows[0].tile))).tolist() == grey[:4, :4].tolist()
    assert media.difference_hash(np.tile(np.arange(18.0), (9, 1))) == "ff" * 8


def test_empty_tables(docs_of):
    empty = docs_of([]).filter(F.lit(False))
    for op in (secrets.op4_secret_scans, bpe.op6_byte_bpe, media.op10_media_columns):
        assert op(empty).count() == 0
