"""Secret scans: all rules in one pass of each text's bytes by one minimal automaton.

The rules' regexes are compiled together (``automata``) to one transition array
that looks for all of them at every byte. Where it accepts, that rule's reversed
automaton finds the leftmost start and its own forward automaton the longest end:
leftmost matches without overlap, rule by rule. Lengths are checked after that, so
a match that is too short is dropped but consumed, as with a regex.

Spans are code points, end exclusive, sorted by start and then in the order of the
rules.

Edge cases: a null text counts as empty and has no spans. Time is linear in the
bytes, so very long texts need nothing special. Rows are scanned one by one: equal
rows give equal results, an empty table an empty one. Only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.automata import Dfa, compile_dfa, longest, parse, reverse
from meridia.llm.common import lean


@dataclass(frozen=True)
class SecretRule:
    """``least``: characters of the whole match; ``least_value``: of the run that ends it."""

    kind: str
    pattern: str
    least: int = 1
    least_value: int = 1


BASE_RULES = (
    SecretRule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        least_value=6,
    ),
    SecretRule("access", "AKIA[A-Z0-9]+", least=20),
    SecretRule("hex", "[0-9a-f]{24,}", least=24),
)
#: Further public formats. Runs are open-ended here and their lengths checked after,
#: which keeps the automaton small: each rule that ends in a run of letters and digits
#: about doubles the states, as it has to be remembered beside the others.
RULES = (
    *BASE_RULES,
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    SecretRule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=20),
    SecretRule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class Scanner:
    def __init__(self, rules: tuple[SecretRule, ...] = RULES) -> None:
        trees = [parse(x.pattern) for x in rules]
        self.rules = rules
        self.all: Dfa = compile_dfa(trees, anywhere=True)
        self.ahead = [compile_dfa([x], anywhere=False) for x in trees]
        self.back = [compile_dfa([reverse(x)], anywhere=False) for x in trees]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) of all matches in bytes, in the order of start and rule."""
        out: list[tuple[int, int, int]] = []
        done = [0] * len(self.rules)
        table, state, accept = self.all.table, self.all.start, self.all.first_accept
        for i, c in enumerate(data.translate(self.all.classes)):
            state = table[state + c]
            if state >= accept:
                for k in self.all.accepts[state]:
                    if i >= done[k]:
                        _, n = longest(self.back[k], data, i, done[k] - 1, -1)
                        if n > 0:
                            start = i + 1 - n
                            first, n = longest(self.ahead[k], data, start, len(data))
                            done[k] = start + n
                            if n >= self.rules[k].least and n - first + 1 >= self.rules[k].least_value:
                                out.append((start, start + n, k))
        return sorted(out, key=lambda x: (x[0], x[2]))

    def text_spans(self, text: str) -> list[tuple[int, int, int]]:
        """The same in code points."""
        data = text.encode("utf-8", "replace")
        found = self.spans(data)
        if not found or len(data) == len(text):
            return found
        out, at, chars = [], 0, 0
        for start, end, k in found:
            chars, at = chars + len(data[at:start].decode("utf-8", "replace")), start
            out.append((chars, chars + end - start, k))  # matches are ASCII
        return out


@lru_cache(maxsize=4)
def scanner(rules: tuple[SecretRule, ...] = RULES) -> Scanner:
    """Compiled once on the driver; its arrays, some 100 kB, go to the executors with the task."""
    return Scanner(rules)


def find_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans: array of (kind, start, end) of every text."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    kinds, scan = [x.kind for x in rules], scanner(rules)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(kinds[k], a, b) for a, b, k in scan.text_spans(x.as_py() or "")] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["key", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(work), f"key {kind}, spans array<struct<kind:string,start:int,end:int>>")
    return found.withColumnRenamed("key", key)


def redact(text: str, spans: list[tuple[int, int, int]], mask: str = "<secret>") -> str:
    """``text`` with spans masked; overlapping ones as one."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op4_secret_scans(docs: DataFrame) -> DataFrame:
    base = [x.kind for x in BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_base = F.filter("spans", lambda x: x["kind"].isin(*base))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs).select("doc_id", *(count(x) for x in base), F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


