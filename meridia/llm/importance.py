"""Importance resampling towards a target: hashed n-gram counts of a corpus and of a target text set.

A block of texts gets an integer word dictionary: distinct words have ids, an n-gram is
a tuple of ids, and of each distinct tuple of the block the bytes are put together and
hashed once. Counts (for the two distributions) and gains (for the weights) are joined
back to the tuples, and through them to the places in the texts. Dictionaries are per
block of ``BLOCK`` bytes of text: one for the corpus would shuffle all of its words only
to save hashes. What leaves a task are counts of buckets, or one row a text.

The weight of a document is the mean gain of its features. Gumbel noise from a hash of
seed and id makes the best scores a draw without replacement, the same for any
partitioning. Ranks need no sort of all rows: documents of each score are counted (scores
are integers within about 100,000 of 0), and only those drawn are ordered, score by score.

Edge cases: a null or empty text has no features, weight 0, and too few words to be drawn;
a null id gets the noise of an empty id and comes after all others in ties. Rows equal in
all that is returned are counted once and dealt out again, however many they are. Very
long texts are a block of their own. An empty corpus gives no rows; an empty target makes
gains that depend on the corpus alone. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import lean, repeated, written

#: Bytes of text that share a dictionary; a longer text has its own.
BLOCK = 8 << 20
#: Bytes of words stay (A-Z lower-cased), all others become spaces; bytes from 128 on are parts of characters.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class Features:
    """Runs of ``shortest`` to ``longest`` words, hashed into ``buckets``."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000

    def __post_init__(self) -> None:
        if not 1 <= self.shortest <= self.longest or not 1 <= self.buckets <= 1 << 20:
            raise ValueError("runs have at least one word; buckets are 1 to 1,048,576, as all of their counts go to the driver")


class Dictionary(dict):
    """Ids of words, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


@dataclass(frozen=True)
class Tuples:
    """The n-grams of one length in a block: the bucket of each distinct one, and where they stand."""

    buckets: np.ndarray  # of each distinct tuple
    at: np.ndarray  # the tuple at each place that has one
    texts: np.ndarray  # the text of each such place


def tuples_of(texts: list[bytes], features: Features) -> tuple[np.ndarray, list[Tuples]]:
    """Words of each text, and the tuples of each length."""
    dictionary = Dictionary()
    ids = [np.fromiter(map(dictionary.__getitem__, text.translate(WORD_BYTES).split()), np.int64) for text in texts]
    counts = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([*ids, np.empty(0, np.int64)])
    owner = np.repeat(np.arange(len(ids)), counts)
    words = list(dictionary)
    out, places, rows = [], np.arange(len(flat)), flat
    tuples = np.arange(len(words))[:, None]
    for length in range(1, features.longest + 1):
        if length > 1:  # tuples that a word of the same text follows, with that word
            more = np.append(owner[places[:-1] + length - 1] == owner[places[:-1]], False) if len(places) else np.empty(0, bool)
            places, rows = places[more], rows[more]
            keys, rows = np.unique(rows * len(words) + flat[places + length - 1], return_inverse=True)
            tuples = np.column_stack([tuples[keys // max(len(words), 1)], keys % max(len(words), 1)])
        if length >= features.shortest:
            hashed = (zlib.crc32(b" ".join([words[i] for i in row])) % features.buckets for row in tuples.tolist())
            out.append(Tuples(np.fromiter(hashed, np.int64, len(tuples)), rows, owner[places]))
    return counts, out


def _blocks(texts: pa.Array) -> Iterator[list[bytes]]:
    """Texts in blocks of up to ``BLOCK`` bytes, or of one text; null ones are empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    block = np.cumsum(pc.binary_length(texts).to_numpy()) // BLOCK
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1), len(texts)]
    for low, high in zip(edges, edges[1:], strict=False):
        yield texts.slice(low, high - low).to_pylist()


def bucket_counts(texts: DataFrame, features: Features, text: str = "text") -> np.ndarray:
    """How often each bucket occurs in all of ``texts``; a task sends one row a bucket at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(features.buckets, np.int64)
        for batch in batches:
            for block in _blocks(batch.column(0)):
                for found in tuples_of(block, features)[1]:
                    often = np.bincount(found.at, minlength=len(found.buckets))
                    np.add.at(totals, found.buckets, often)
        there = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(totals[there])], names=["bucket", "often"])

    rows = texts.select(F.col(text).cast("string")).mapInArrow(lean(work), "bucket int, often long").groupBy("bucket").agg(F.sum("often").alias("often"))
    totals = np.zeros(features.buckets, np.int64)
    found = rows.toArrow()
    totals[found["bucket"].to_numpy()] = found["often"].to_numpy()
    return totals


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What an occurrence of each bucket adds: the log of the smoothed ratio of target and corpus, in thousandths, rounded down."""
    n = len(corpus)
    ratio = (target + 1.0) * (corpus.sum() + float(n)) / ((corpus + 1.0) * (target.sum() + float(n)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, features: Features, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight``, the mean gain rounded down; columns with these names are replaced."""
    added = ("n_words", "n_features", "weight")
    kept = [c for c in docs.columns if c.lower() not in added]
    position = kept.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for block in _blocks(batch.column(position)):
                words, lengths = tuples_of(block, features)
                many, total = np.zeros((2, len(block)), np.int64)
                for found in lengths:
                    many += np.bincount(found.texts, minlength=len(block))
                    ends = np.append(0, np.cumsum(gains[found.buckets][found.at]))  # exact, unlike float weights of bincount
                    edge = np.searchsorted(found.texts, np.arange(len(block) + 1))
                    total += np.diff(ends[edge])
                parts.append(np.stack([words, many, total // np.maximum(many, 1)]))
            values = np.concatenate(parts, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, values)], names=[*kept, *added])

    out = docs.select(*kept)
    return out.mapInArrow(lean(work), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + "".join(f", {x} long" for x in added))


def score(weight: Column, key: Column, seed: int) -> Column:
    """The weight with Gumbel noise of a hash of seed and key, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return (weight + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))).cast("long")


def drawn(rows: DataFrame, percent: int, least_words: int, key: str = "doc_id") -> DataFrame:
    """``rows`` (key, n_words, n_features, weight, score; a written table) with ``rank``, null where not drawn."""
    fits = F.col("n_words") >= least_words
    often = rows.filter(fits).groupBy("score").agg(F.count("*").alias("often"))
    # A row a score: at most some 200,000, as weights are within 1000 * ln of all features, noise within 23,000.
    before = often.withColumn("before", F.sum("often").over(Window.orderBy(F.desc("score"))) - F.col("often"))
    before = written(before, "scores")
    most = (before.agg(F.sum("often")).first()[0] or 0) * percent // 100
    cut = before.filter(F.col("before") < most).agg(F.min("score")).first()[0]
    if cut is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    near = fits & (F.col("score") >= cut)
    columns = [key, "n_words", "n_features", "weight", "score"]
    counted = rows.filter(near).groupBy(*columns).agg(F.count("*").alias("times")).join(F.broadcast(before.select("score", "before")), "score")
    within = Window.partitionBy("score").orderBy(F.asc_nulls_last(key), "n_features", "weight", "n_words").rowsBetween(Window.unboundedPreceding, 0)
    first = counted.withColumn("first", F.col("before") + F.sum("times").over(within) - F.col("times"))
    place = F.col("first") + F.col("copy") + 1
    ranked = repeated(first, "times", "copy").select(*columns, F.when(place <= most, place).alias("rank"))
    return ranked.unionByName(rows.filter(~near).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = 10, features: Features = Features(), seed: int = 2024, least_words: int = 20, key: str = "doc_id", text: str = "text", target_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that are drawn, all of their columns, with ``weight`` and ``score``.

    The draw is a threshold of score and key, so texts aren't shuffled; rows that equal
    the last one drawn in both come along.
    """
    gains = gains_of(bucket_counts(docs, features, text), bucket_counts(target, features, target_text))
    scored = weighted(docs, gains, features, text).withColumn("score", score(F.col("weight"), F.col(key), seed))
    ranked = drawn(written(scored.select(key, "n_words", "n_features", "weight", "score"), "scored"), percent, least_words, key)
    last = ranked.filter("rank IS NOT NULL").orderBy(F.desc("rank")).limit(1).collect()
    if not last:
        return scored.limit(0)
    edge, ident = last[0]["score"], last[0][key]
    same = F.lit(True) if ident is None else F.col(key) <= F.lit(ident)
    return scored.filter((F.col("n_words") >= least_words) & ((F.col("score") > edge) | ((F.col("score") == edge) & same)))


def op11_importance(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document's features, weight and score, and the rank of the tenth that is drawn for the benchmark's distribution."""
    features = Features(1, 1, 10_000)
    gains = gains_of(bucket_counts(docs, features), bucket_counts(benchmark, features))
    scored = weighted(docs.select("doc_id", "text"), gains, features).drop("text").withColumn("score", score(F.col("weight"), F.col("doc_id"), 2024))
    return drawn(written(scored, "scored"), 10, 20).select("doc_id", "n_features", "weight", "score", "rank")


def oracle_sql() -> str:
    return r"""
WITH crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS k),
found AS MATERIALIZED (
  SELECT 'corpus' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'target', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
hexed AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM found)),
buckets AS MATERIALIZED (
  SELECT word, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, k[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket
  FROM hexed, crc_table),
often AS (SELECT bucket, count(*) FILTER (side = 'corpus') AS s, count(*) FILTER (side = 'target') AS t FROM found JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM often),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM often, totals),
weights AS (SELECT id, count(*) AS n, sum(gain) AS total FROM found JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 'corpus' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
    coalesce(floor(total::DOUBLE / n), 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights ON doc_id = id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= floor(10 * n / 100) THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)"""
