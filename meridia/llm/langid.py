"""Language identification: known words first, shorter and shorter n-grams for unseen ones.

``fit`` counts words by language on a bounded sample of each language's labelled rows and
keeps each language's most frequent ones; n-grams come from these words, marked at their
ends. ``Scorer`` adds up a vector of log posteriors a word: that of a known word from its
log frequency in each language, that of an unseen word from the longest n-grams of it
that are known. Words and n-grams are kept as sorted 64-bit hashes beside a matrix, some
24 bytes each for four languages, so that a worker holds a few MB.

Edge cases: a null text, and one without a letter, gives ``und`` with score 0, as does
a model without any language. Rows with a null label or text are not learned from. A
text of letters that were never seen gets the first language and an even score. Ties
go to the alphabetically first language. Whole texts are scored, one by one: time is
linear, repeated rows score equally, an empty table gives an empty result. Only the
named columns are read; ``keep_known`` passes all others on, whatever their names. More
than ``most_languages`` labels are an error.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import held_out, lean

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Characters of texts that are scored together.
GROUP_CHARS = 1_000_000


@dataclass(frozen=True)
class Limits:
    """What bounds the model, whatever the size of the table."""

    sample_rows: int = 5_000  # labelled rows of each language that are learned from, about
    most_words: int = 25_000  # words of each language, the most frequent ones
    most_languages: int = 1_000
    longest_gram: int = 5
    floor: float = -7.0  # the least log posterior that a word can give
    worth_words: float = 20.0  # a text counts as so many independent words at most
    remembered: int = 100_000  # words a worker keeps


def threshold(most: int, rows: int) -> int:
    """Of hashes from 0 to 2**63 - 1, those below this are about ``most`` of ``rows``, or all."""
    return 2**63 - 1 if rows <= most else most * 2**63 // rows


def place(by: Column) -> Column:
    """A row's place among 2**63, by a hash."""
    return F.shiftrightunsigned(F.xxhash64(by, F.lit("sample")), 1)


def bounded_sample(rows: DataFrame, by: Column, most: int) -> DataFrame:
    """About ``most`` of ``rows``, or all: those whose hash is in the share that this is of their number."""
    n = rows.count()
    return rows if n <= most else rows.filter(place(by) < threshold(most, n))


def sample_by_language(rows: DataFrame, limits: Limits) -> DataFrame:
    """About ``sample_rows`` of the rows (k, t, lang) of each language, or all of them."""
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(limits.most_languages + 1).collect()
    if len(counts) > limits.most_languages:
        raise ValueError(f"more than {limits.most_languages} languages")
    cut = [F.lit(x) for r in counts if r.n > limits.sample_rows for x in (r.lang, threshold(limits.sample_rows, r.n))]
    return rows.filter(place(F.col("k")) < F.coalesce(F.element_at(F.create_map(*cut), F.col("lang")), F.lit(2**63 - 1))) if cut else rows


def hashes(items: Sequence[str]) -> np.ndarray:
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(x.encode("utf-8", "surrogatepass")) for x in items), np.uint64, len(items))


@dataclass(frozen=True)
class Table:
    """A row of values for each of many strings, which are kept as sorted hashes."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys)
        return Table(keys[order], values[order].astype(np.float32))

    @staticmethod
    def of_mapping(items: Mapping[str, Sequence[float]], width: int) -> Table:
        return Table.of(hashes(list(items)), np.array(list(items.values()), float).reshape(len(items), width))

    def find(self, items: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The row of each item, and whether there is one."""
        wanted = hashes(items)
        if not len(self.keys) or not len(wanted):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return at, self.keys[at] == wanted


@dataclass(frozen=True)
class Model:
    """Log posteriors of known words and n-grams, as tables or as mappings."""

    languages: tuple[str, ...]
    words: Table | Mapping[str, Sequence[float]]
    grams: Table | Mapping[str, Sequence[float]]
    limits: Limits = Limits()


def posteriors(counts: np.ndarray, floor: float, smooth: float = 0.5) -> np.ndarray:
    """Log posterior of each language (even priors) for each item (a row), from its log frequency in each."""
    v = np.log(counts + smooth) - np.log(counts.sum(axis=0) + smooth * max(1, len(counts)))
    v -= v.max(axis=1, keepdims=True, initial=-np.inf)
    v -= np.log(np.exp(v).sum(axis=1, keepdims=True))
    return np.maximum(v, floor)


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word with its ends marked; of 1-grams, those of the word itself."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def gram_counts(words: Sequence[str], counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sums of log1p of the counts of their words) of all n-grams of ``words``."""
    one, keys, of = xxhash.xxh64_intdigest, array("Q"), array("L")
    for i, word in enumerate(words):
        for n in range(1, longest + 1):
            found = grams_of(word, n)
            keys.extend([one(x.encode("utf-8", "surrogatepass")) for x in found])
            of.extend([i] * len(found))
    distinct, at = np.unique(np.frombuffer(keys, np.uint64), return_inverse=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    of, logs = np.frombuffer(of, np.uint64).astype(np.int64) if of else np.zeros(0, np.int64), np.log1p(counts)
    sums = [np.bincount(at, weights=logs[of, k], minlength=len(distinct)) for k in range(counts.shape[1])]
    return distinct, np.stack(sums, axis=1) if sums else np.zeros((len(distinct), 0))


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang", limits: Limits = Limits()) -> Model:
    """A model from rows that have a label; ``most_words`` rows of each language come to the driver."""
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("string").alias("lang"))
    words = sample_by_language(rows, limits).select("lang", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), 0)).alias("word"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).select("*", F.row_number().over(order).alias("rank"))
    counted = counted.filter(F.col("rank") <= limits.most_words).select("lang", "word", "n").toArrow().to_pandas()
    languages = sorted(set(counted["lang"]))
    at, distinct = pd.factorize(counted["word"])
    counts = np.zeros((len(distinct), len(languages)))
    counts[at, [languages.index(x) for x in counted["lang"]]] = counted["n"]
    frequent = counts.sum(axis=1) >= 2
    frequent = frequent if frequent.any() else np.ones(len(distinct), bool)
    known = Table.of(hashes(distinct[frequent].tolist()), posteriors(counts[frequent], limits.floor))
    keys, sums = gram_counts(distinct.tolist(), counts, limits.longest_gram)
    return Model(tuple(languages), known, Table.of(keys, posteriors(sums, limits.floor)), limits)


class Scorer:
    """Scores texts in one process; remembers a bounded number of words."""

    def __init__(self, model: Model) -> None:
        self.model, width = model, len(model.languages)
        self.words, self.grams = (x if isinstance(x, Table) else Table.of_mapping(x, width) for x in (model.words, model.grams))
        self.row: dict[str, int] = {}
        self.rows = np.zeros((model.limits.remembered, width))

    def unseen(self, word: str) -> np.ndarray:
        """Mean vector of the word's longest known n-grams; even where not one letter is known."""
        return self.unseen_all([word])[0]

    def unseen_all(self, words: list[str]) -> np.ndarray:
        width = len(self.model.languages)
        out = np.full((len(words), width), -math.log(max(1, width)))
        left = np.arange(len(words))
        for n in range(self.model.limits.longest_gram, 0, -1):
            found = [grams_of(words[i], n) for i in left]
            at, known = self.grams.find([g for x in found for g in x])
            of = np.repeat(np.arange(len(left)), [len(x) for x in found])[known]
            hits = np.bincount(of, minlength=len(left))
            sums = np.zeros((len(left), width))
            np.add.at(sums, of, self.grams.values[at[known]])
            out[left[hits > 0]] = sums[hits > 0] / hits[hits > 0, None]
            left = left[hits == 0]
            if not len(left):
                break
        return out

    def learn(self, distinct: set[str]) -> None:
        """A vector for each of ``distinct`` words; what was known before is forgotten if room is short."""
        new = [w for w in distinct if w not in self.row]
        if len(self.row) + len(new) > len(self.rows):
            new, self.row = list(distinct), {}
            self.rows = np.zeros((max(self.model.limits.remembered, len(new)), len(self.model.languages)))
        if not new:
            return
        at, known = self.words.find(new)
        start = len(self.row)
        vectors = np.zeros((len(new), len(self.model.languages)))
        vectors[known] = self.words.values[at[known]]
        if not known.all():
            vectors[~known] = self.unseen_all([w for w, k in zip(new, known, strict=True) if not k])
        self.rows[start : start + len(new)] = vectors
        self.row.update(zip(new, range(start, start + len(new)), strict=True))

    def predict_all(self, texts: Iterable[str]) -> list[tuple[str, float]]:
        """(language, score) of each text; texts are worked on in groups of some size."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(WORD.findall(text.lower()))
            size += len(text)
            if size > GROUP_CHARS:
                out += self._predicted(group)
                group, size = [], 0
        return out + self._predicted(group)

    def _predicted(self, group: list[list[str]]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(group)
        self.learn({w for words in group for w in words})
        out = []
        for words in group:
            if not any(c.isalpha() for w in words for c in w):
                out.append((UNKNOWN, 0.0))
                continue
            total = self.rows[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(axis=0)
            mean = total / len(words) * min(len(words), self.model.limits.worth_words)
            p = np.exp(mean - mean.max())
            best = int(p.argmax())
            out.append((self.model.languages[best], float(p[best] / p.sum())))
        return out

    def predict(self, text: str) -> tuple[str, float]:
        return self.predict_all([text])[0]


def _scored(docs: DataFrame, model: Model, columns: list[str], kinds: str, text: str, keep: float | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = scorer.predict_all(x.as_py() or "" for x in batch.column(at))
            if keep is not None:
                yield batch.filter(pa.array([lang != UNKNOWN and p >= keep for lang, p in found], pa.bool_()))
            else:
                languages, scores = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=["key", "lang_pred", "score"])

    return docs.select(*columns).mapInArrow(lean(work), kinds)


def predict(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of every text."""
    both = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return _scored(both, model, ["key", "text"], f"key {kind}, lang_pred string, score double", "text", None).withColumnRenamed("key", key)


def keep_known(docs: DataFrame, model: Model, *, text: str = "text", least: float = 0.4) -> DataFrame:
    """Rows of ``docs`` whose text is in a learned language, with score ``least`` or more."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return _scored(docs, model, docs.columns, kinds, text, least)


def op5_language_id(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    model = fit(docs.filter(~held_out()), limits=limits)
    out = predict(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accuracy(judged: DataFrame, label: str = "lang") -> Counter:
    """Counts of (label, prediction) over held-out rows that have a label."""
    rows = judged.filter(F.col("held_out") & F.col(label).isNotNull()).groupBy(label, "lang_pred").count().collect()
    return Counter({(r[0], r[1]): r[2] for r in rows})
