"""Toxicity: lexicon terms, misspelled ones too, scored in their context.

The lexicon is learned: words, and stems that words start with, that mark toxic
rows. A trie holds its terms. The Levenshtein automata of all terms are intersected
with it: a state is a set of (trie node, edits so far), built once it is reached and
kept, so that each distinct word is one walk of a deterministic automaton. Each hit
counts by its term's weight, less for edits, less inside quotation marks or after
words of reporting, more next to an address in the second person. A logistic model of
a text's hits gives the score.

The lexicon is learned from labelled rows whose remainder (crc32 of the id modulo 3)
is 0, the logistic weights from those with remainder 2, so that weights are not fitted
to the rows that chose the terms.

Edge cases: a null text counts as empty and scores as a text without hits. Without
labels of both kinds every score is the share of toxic rows, 0 if there are none.
A null label is not learned from; copies of a text count once, toxic if any is. Whole texts are
scored one by one in linear time. An empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import held_out, lean, written
from meridia.llm.langid import bounded_sample

WORD = re.compile(r"[^\W_]+")
QUOTES = "\"'“”„«»‘’‹›"
#: Reporting and distancing words of the languages expected, and the second person.
REPORTING = frozenset("said says wrote called quote quoted term word slur alleged dit écrit mot sagte schrieb wort dijo escribió palabra".split())
SECOND = frozenset("you your youre ur du dein ihr euch tu te toi vous votre usted tú ustedes".split())


@dataclass(frozen=True)
class Limits:
    """What bounds the model, whatever the size of the tables."""

    sample_rows: int = 40_000  # labelled rows that are learned from, about; all terms that they show are kept
    least_rows: int = 4  # toxic rows that have a term, at least
    least_share: float = 0.8  # of a term's rows that are toxic
    stem: tuple[int, int] = (4, 8)  # characters of stems
    window: int = 6  # words on either side of a hit
    remembered: int = 300_000  # words a worker keeps


@dataclass(frozen=True)
class Term:
    text: str
    weight: float
    stem: bool = False

    @property
    def edits(self) -> int:
        """Edits that still count as this term: none for short ones and stems."""
        return 0 if self.stem or len(self.text) < 5 else 1 if len(self.text) < 9 else 2


class LexiconAutomaton:
    """Levenshtein automata of all terms, intersected with their trie, made deterministic as needed.

    States are frozen sets of (node, edits). A node is (children, terms that end there);
    a stem that has been read in full stays matched whatever follows.
    """

    def __init__(self, terms: list[Term], most_states: int = 100_000) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach = [0]  # edits that any term below a node allows
        self.terms, self.most_states = terms, most_states
        for i, term in enumerate(terms):
            node = 0
            self.reach[0] = max(self.reach[0], term.edits)
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], term.edits)
            self.ends[node].append(i)
        self.first = self._closed({(0, 0)})
        self.moves: dict[frozenset, dict] = {}
        self.members: dict[int, frozenset] = {}

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With characters of the term left out, an edit each; the fewest edits of a node are kept."""
        best: dict[int, int] = {}
        todo = list(states)
        while todo:
            node, e = todo.pop()
            if e > (self.reach[node] if node >= 0 else 9) or best.get(node, 99) <= e:
                continue
            best[node] = e
            if node >= 0:
                todo += [(x, e + 1) for x in self.children[node].values()]
        return frozenset(best.items())

    def _step(self, state: frozenset, c: str) -> frozenset:
        out: set[tuple[int, int]] = set()
        for node, e in state:
            if node < 0:
                out.add((node, e))
                continue
            for i in self.ends[node]:
                if self.terms[i].stem and e == 0:
                    out.add((-1 - i, 0))  # a finished stem
            if (to := self.children[node].get(c)) is not None:
                out.add((to, e))
            out.add((node, e + 1))
            out.update((x, e + 1) for x in self.children[node].values())
        return self._closed(out)

    def _state(self, members: frozenset) -> dict:
        """A state as the table of its moves so far: character to table; the dead one is empty for good."""
        table = self.moves.get(members)
        if table is None:
            table = self.moves[members] = {}
            self.members[id(table)] = members
        return table

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best term for a word: fewest edits, then most weight."""
        if len(self.moves) > self.most_states:
            self.moves.clear()
            self.members.clear()
        state = self._state(self.first)
        for c in word:
            to = state.get(c)
            if to is None:
                if not self.members[id(state)]:
                    return None
                to = state[c] = self._state(self._step(self.members[id(state)], c))
            state = to
        hits = []
        for node, e in self.members[id(state)]:
            for i in [-1 - node] if node < 0 else self.ends[node]:
                if e <= self.terms[i].edits:
                    hits.append((e, -self.terms[i].weight, i))
        return (min(hits)[2], min(hits)[0]) if hits else None


@dataclass(frozen=True)
class Model:
    terms: tuple[Term, ...]
    weights: tuple[float, ...]  # of features(), the constant first
    limits: Limits = field(default_factory=Limits)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.automaton = model, LexiconAutomaton(list(model.terms))
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[int, int]] = {}

    def found(self, words: set[str]) -> set[str]:
        """Those of ``words`` that match a term; each distinct word walks the automaton once."""
        new = words - self.seen
        if len(self.seen) + len(new) > self.model.limits.remembered:
            self.seen.clear()
            self.hits.clear()
            new = words
        for word in new:
            if hit := self.automaton.match(word):
                self.hits[word] = hit
        self.seen |= new
        return words & self.hits.keys()

    def context(self, text: str, words: list[re.Match], at: int) -> float:
        """Times a hit's weight: less in quotation or report, more at the second person."""
        m, window = words[at], self.model.limits.window
        near = {w[0].lower() for w in words[max(0, at - window) : at + window + 1]}
        before = text[words[max(0, at - window)].start() : m.start()]
        after = text[m.end() : words[min(len(words) - 1, at + window)].end()]
        opened = any(before.count(q) % 2 == 1 and q in after for q in "\"“„«‹" if q in before) or (text[m.start() - 1 : m.start()] in QUOTES and text[m.end() : m.end() + 1] in QUOTES and m.start() > 0)
        quoted = opened or any(a in before and z in after for a, z in ("“”", "„“", "«»", "‹›"))
        return (0.4 if quoted else 1.0) * (0.6 if near & REPORTING else 1.0) * (1.25 if near & SECOND else 1.0)

    def features(self, text: str) -> list[float]:
        """Constant, weight of exact hits, of misspelled ones, of the heaviest, share of distanced hits."""
        lowered = text.lower()
        distinct = self.found(set(WORD.findall(lowered)))
        if not distinct:
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        words = list(WORD.finditer(text if len(lowered) == len(text) else lowered))
        exact = fuzzy = most = 0.0
        n = distanced = 0
        for i, m in enumerate(words):
            if (w := m[0].lower()) in distinct:
                term, edits = self.hits[w]
                factor = self.context(m.string, words, i)
                value = self.model.terms[term].weight * factor * 0.5**edits
                exact, fuzzy = (exact + value, fuzzy) if edits == 0 else (exact, fuzzy + value)
                most, n, distanced = max(most, value if edits == 0 else 0.0), n + 1, distanced + (factor < 1)
        return [1.0, math.log1p(exact), math.log1p(fuzzy), most, distanced / max(1, n)]

    def score(self, text: str) -> float:
        z = float(np.dot(self.model.weights, self.features(text))) if text or self.model.weights else 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn_lexicon(rows: DataFrame, limits: Limits = Limits()) -> list[Term]:
    """All terms that rows (t, toxic) show: words and stems. Their number is bounded by that of the rows.

    A term's toxic rows have to be more than chance gives any of the words and stems that
    are looked at: of all these, one is expected to pass by luck.

    Words of any length count, stems have ``limits.stem`` characters. Counts are of rows. Those of a stem add up over its words, and a term is left out
    where a shorter stem says the same.
    """
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return []
    words = rows.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}]+"), 0))).alias("word"))
    counted = words.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all"))
    low, high = limits.stem
    stems = counted.filter(F.length("word") > low).select(
        F.explode(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length("word") - 1)), lambda k: F.substring("word", F.lit(1), k))).alias("word"), "bad", "all"
    )
    stems = stems.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("all").alias("all"))
    both = counted.select("word", "bad", "all", F.lit(False).alias("stem")).unionByName(stems.select("word", "bad", "all", F.lit(True).alias("stem")))
    both = written(both.filter(F.col("all") >= limits.least_rows), "candidates")
    share = n[1] / (n[0] + n[1])
    # at the rate of all rows, so many toxic ones among a term's have this log probability at most (Chernoff's bound)
    part = F.col("bad") / F.col("all")
    part_log = lambda q, p: F.when(q > 0, q * F.ln(q / p)).otherwise(0.0)
    chance = F.col("all") * (part_log(part, share) + part_log(1 - part, 1 - share))
    unlikely = (part > share) & (chance >= math.log(max(1, both.count())))
    # at even rates of toxic and other rows, so that a rare class doesn't hide its terms
    odds = F.col("bad") * (1 - share) / (F.col("bad") * (1 - share) + (F.col("all") - F.col("bad") + 0.5) * share)
    chosen = both.filter((F.col("bad") >= limits.least_rows) & (F.col("bad") >= limits.least_share * F.col("all")) & (odds >= limits.least_share) & unlikely)
    found = chosen.collect()
    terms: list[Term] = []
    taken: dict[str, int] = {}
    for r in sorted(found, key=lambda r: (len(r.word), not r.stem, r.word)):
        shorter = [taken[r.word[:k]] for k in range(low, len(r.word) + (not r.stem)) if r.word[:k] in taken]
        if r.stem and not shorter:
            taken[r.word] = r.bad
        if not shorter or not r.stem:  # a word keeps its own term, for misspelled forms of it
            weight = math.log((r.bad + 0.5) / (n[1] + 1)) - math.log((r["all"] - r.bad + 0.5) / (n[0] + 1))
            terms.append(Term(r.word, round(max(weight, 0.1), 4), r.stem))
    return terms


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method with a ridge on all weights but the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> Model:
    """Model from labelled rows that are not held out.

    A bounded sample of labels is joined, so it is broadcast: ``sample_rows`` pairs of
    numbers. To the driver come the terms of the sample and a few numbers a sampled row.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample = F.broadcast(bounded_sample(known.filter(~held_out()), F.col("doc_id"), limits.sample_rows))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).join(sample, "doc_id")
    # copies of one text say what one says; the sample is read three times below
    rows = written(rows.groupBy("t").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "labelled")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    terms = learn_lexicon(rows.filter(rest == 0).select("t", "toxic"), limits)
    draft = Model(tuple(terms), (), limits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(draft)
        for batch in batches:
            values = [scorer.features(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    got = rows.filter(rest == 2).select("t", "toxic").mapInArrow(lean(work), "x array<double>, toxic int").collect()
    y = np.array([float(r.toxic) for r in got])
    if not terms or not 0 < y.sum() < len(y):
        share = y.mean() if len(y) else 0.0
        return Model((), (math.log((share + 1e-6) / (1 - share + 1e-6)), 0, 0, 0, 0), limits)
    return Model(tuple(terms), tuple(fit_logistic(np.array([r.x for r in got]), y).tolist()), limits)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = [scorer.score(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    both = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return both.mapInArrow(lean(work), f"key {kind}, score double").withColumnRenamed("key", key)


def op1_toxicity(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    out = score(docs, fit(docs, labels, limits))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
