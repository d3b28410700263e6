"""Quality rules: a threshold table compiled into one projection.

Each rule bounds one metric of a text. Metrics and verdicts are built-in Spark
expressions only, so that a scan, one projection and the output make the plan:
no shuffle, no user functions.

Edge cases: a null text has no words and counts as empty; both fail the least
word count, their ratios are null and a null ratio breaks no rule. Rows are
judged one by one, so ties, repeated rows and empty tables need nothing, and
only the columns that are named are read, so further columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import text_or_empty

#: White space of the word definition: space and 0x09 to 0x0D.
SPACE = "[ \\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: Frequent function words of the languages expected; one in 200 words at least.
STOP_WORDS = (
    "the be to of and that have with a in is it for as was "
    "der die das und ist von mit zu den ein eine nicht "
    "le la les de des et un une en est que pour dans "
    "el los las y que por con para una del no se"
)


@dataclass(frozen=True)
class Threshold:
    """Texts whose ``metric`` is below ``low`` or above ``high`` fail ``name``."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The table that is compiled. Ratios are per word, but per line where named so.
THRESHOLDS = (
    Threshold("too_few_words", "n_words", low=50),
    Threshold("too_many_words", "n_words", high=1_000_000),
    Threshold("mean_word_length", "mean_word_chars", low=2.0, high=14.0),
    Threshold("symbols", "symbol_ratio", high=0.5),
    Threshold("stop_words", "stop_word_ratio", low=0.005),
    Threshold("duplicate_lines", "dup_line_ratio", high=0.5),
    Threshold("bullet_lines", "bullet_line_ratio", high=0.9),
    Threshold("ellipsis_lines", "ellipsis_line_ratio", high=0.3),
    Threshold("repeated_windows", "repeat_word_ratio", high=0.5),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _with_arrays(frame: DataFrame, text: str) -> DataFrame:
    clean = text_or_empty(text)
    return frame.select("*", clean.alias("_text"), words_of(clean).alias("_words")).select(
        "*",
        F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")).alias("_lines"),
        F.when(
            F.size("_words") >= 3,
            F.transform(
                F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2)),
            ),
        ).alias("_windows"),
    )


def _sorted_windows() -> Column:
    """(hash, position) of each three-word window, sorted, where any window repeats."""
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    return F.when(repeats, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))


def _repeated_positions() -> Column:
    same = F.zip_with("_sorted", F.slice("_sorted", F.lit(2), F.size("_sorted")), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    # same[i]: window i of the sorted array equals the next one
    return F.when(F.col("_sorted").isNotNull(), same)


def _covered() -> Column:
    """Words in windows at the sorted positions ``_at``: each adds what the one before left."""
    return F.coalesce(
        F.aggregate(
            "_at",
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        ),
        F.lit(0),
    )


def metrics(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and ratios of every text: the key, then one column a metric."""
    frame = _with_arrays(docs.select(F.col(key).alias(key), F.col(text).alias("_raw")), "_raw")
    frame = frame.select("*", _sorted_windows().alias("_sorted"))
    frame = frame.select("*", _repeated_positions().alias("_same"))
    hit = lambda x, i: F.get("_same", i) | F.coalesce(F.get("_same", i - 1), F.lit(False))
    frame = frame.select("*", F.sort_array(F.transform(F.filter("_sorted", hit), lambda x: x["i"])).alias("_at"))
    words, lines = F.size("_words"), F.size("_lines")
    frame = frame.select(
        key,
        words.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered().cast("long").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda x: F.lower(x).isin(*set(STOP_WORDS.split())))).cast("long").alias("n_stop_words"),
        lines.cast("long").alias("n_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike("^\\s*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike("(\\.\\.\\.|…)\\s*$"))).cast("long").alias("n_ellipsis_lines"),
    )
    per_word = lambda x: F.try_divide(F.col(x).cast("double"), F.col("n_words"))
    per_line = lambda x: F.try_divide(F.col(x).cast("double"), F.col("n_lines"))
    return frame.select(
        "*",
        per_word("word_chars").alias("mean_word_chars"),
        per_word("n_symbols").alias("symbol_ratio"),
        per_word("n_stop_words").alias("stop_word_ratio"),
        per_word("n_repeat_words").alias("repeat_word_ratio"),
        per_line("n_dup_lines").alias("dup_line_ratio"),
        per_line("n_bullet_lines").alias("bullet_line_ratio"),
        per_line("n_ellipsis_lines").alias("ellipsis_line_ratio"),
    )


def compile_rules(thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """The names of the rules that a row of ``metrics`` breaks, as an array column."""

    def broken(rule: Threshold) -> Column:
        sides = [F.col(rule.metric) < rule.low] if rule.low is not None else []
        sides += [F.col(rule.metric) > rule.high] if rule.high is not None else []
        if not sides:
            raise ValueError(f"rule {rule.name} has no bound")
        return F.when(F.coalesce(reduce(Column.__or__, sides), F.lit(False)), F.lit(rule.name))

    if not thresholds:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(broken(x) for x in thresholds)))


def judge(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``metrics`` with ``broken_rules`` and ``kept`` (no rule is broken)."""
    judged = metrics(docs, key=key, text=text).select("*", compile_rules(thresholds).alias("broken_rules"))
    return judged.select("*", (F.size("broken_rules") == 0).alias("kept"))


def op9_quality_rules(docs: DataFrame) -> DataFrame:
    """The contract's columns, the ratios and the broken rules of every document."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judge(docs).select(
        *base,
        failed.alias("base_failed"),
        (F.col("kept") & ~failed).alias("kept"),
        "n_stop_words",
        "n_lines",
        "n_bullet_lines",
        "n_ellipsis_lines",
        F.array_join("broken_rules", ",").alias("broken_rules"),
    )


def _sql_rule(rule: Threshold, ratios: dict[str, str]) -> str:
    metric = ratios.get(rule.metric, rule.metric)
    sides = [f"{metric} < {rule.low}"] if rule.low is not None else []
    sides += [f"{metric} > {rule.high}"] if rule.high is not None else []
    return f"CASE WHEN {' OR '.join(sides)} THEN '{rule.name}' END"


def oracle_sql(thresholds: tuple[Threshold, ...] = THRESHOLDS) -> str:
    """The same in DuckDB's SQL, with windows as strings, not hashes."""
    ratios = {
        "mean_word_chars": "word_chars / nullif(n_words, 0)",
        "symbol_ratio": "n_symbols / nullif(n_words, 0)",
        "stop_word_ratio": "n_stop_words / nullif(n_words, 0)",
        "repeat_word_ratio": "n_repeat_words / nullif(n_words, 0)",
        "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)",
        "bullet_line_ratio": "n_bullet_lines / nullif(n_lines, 0)",
        "ellipsis_line_ratio": "n_ellipsis_lines / nullif(n_lines, 0)",
    }
    stop = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS.split())))
    rules = ", ".join(_sql_rule(x, ratios) for x in thresholds)
    return f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents
), a AS (
  SELECT doc_id, rid, t, list_filter(regexp_split_to_array(t, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS l
  FROM d
), g AS (
  SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM a WHERE len(w) >= 3
), k AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM g
), r AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n >= 2) GROUP BY rid
), m AS (
  SELECT a.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
         len(l)::BIGINT AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-*•]')))::BIGINT AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$')))::BIGINT AS n_ellipsis_lines
  FROM a LEFT JOIN r ON a.rid = r.rid
), j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         array_to_string(list_filter([{rules}], lambda x: x IS NOT NULL), ',') AS broken_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       broken_rules = '' AND NOT base_failed AS kept, n_stop_words, n_lines, n_bullet_lines, n_ellipsis_lines, broken_rules
FROM j
"""
