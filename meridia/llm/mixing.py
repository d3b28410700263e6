"""Mixing to target weights: hierarchical budgets over domain, language and source.

A token budget runs down the tree. At each node the children share it by weight; one
that can't use its share (its tokens, times the epochs allowed, are fewer) leaves the
rest to its siblings by their weights, and only what all children of a node can't use
goes back to its own siblings. This water-filling has a closed form: with children in
the order of capacity per weight, the level is the largest of
(budget - capacities before) / (weights from here on), so it is one window a level over
the distinct values of capacity per weight among a node's children.

Each leaf reads its documents in seeded epochs, each in an order of its own by a hash
of seed, epoch and id. The budget takes whole epochs and then a prefix of the next: all
documents up to the one that reaches the budget. The prefix is found without sorting a
leaf: tokens are summed by ranges of the hash, their running sums name one range, and
only its few thousand documents are put in order. A leaf's selection is then a
threshold, and applying it is a filter with a join of the few leaves: texts aren't
shuffled, and a leaf with a third of all rows is as parallel as the table.

Edge cases: null or missing domain, language and source count as empty names, with the
default weight. A weight of 0 gives no tokens to all that is below, and what is there
counts nowhere as capacity; a negative one is an error. A null or
empty text has no tokens and comes along if the prefix reaches it. Very long texts are
rows like others: the one that reaches the budget is taken whole. Rows that share an
id share their fate; null ids count as the smallest id. A target above what there is
selects everything, for all epochs allowed. An empty table gives an empty result.
Columns that ``select_mix`` isn't told of are passed on, whatever their names, but
``copies``, which takes the place of a column of that name.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import fresh, text_or_empty, written

LEVELS = ("domain", "language", "source")
SPACE = "[ \\x09-\\x0D]+"
#: Documents of one hash range, about, and most leaves that are broadcast.
RANGE, MOST_LEAVES = 4096, 20_000


@dataclass(frozen=True)
class Weights:
    """Weights of children by their path from the root, such as ("web", "en"); 1 where none is given."""

    of: Mapping[tuple[str, ...], float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if any(w < 0 for w in self.of.values()):
            raise ValueError("weights can't be negative")

    def column(self, depth: int) -> Column:
        listed = {path: w for path, w in self.of.items() if len(path) == depth}
        if not listed:
            return F.lit(1.0)
        name = lambda path: "\x1f".join(path)
        table = F.create_map(*(F.lit(x) for path, w in listed.items() for x in (name(path), float(w))))
        return F.coalesce(F.element_at(table, F.concat_ws("\x1f", *LEVELS[:depth])), F.lit(1.0))


def source_domain(source: str = "source") -> Column:
    """The domain of a source where a table has none: its number modulo 4, else its name."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"(\d{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (number.cast("int") % 4).cast("string"))).otherwise(F.coalesce(F.col(source), F.lit("")))


def token_count(text: str = "text") -> Column:
    """Words between white space."""
    return F.size(F.array_remove(F.split(text_or_empty(text), SPACE), "")).cast("long")


def position(epoch: Column, seed: int, doc_id: Column) -> Column:
    """A document's place in an epoch's order, from 0 to 2**62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("long"), doc_id), 2)


def allocate(leaves: DataFrame, target: float, weights: Weights) -> DataFrame:
    """``leaves`` (domain, language, source, capacity) with their ``budget``.

    Siblings of equal capacity per weight are one row of the window that fills a node.
    """
    reached = reduce(and_, (weights.column(depth) > 0 for depth in (1, 2, 3)))
    useful = F.when(reached, F.col("capacity")).otherwise(0.0).alias("useful")
    nodes = {3: leaves.select(*LEVELS, useful)}
    for depth in (2, 1):
        nodes[depth] = nodes[3].groupBy(*LEVELS[:depth]).agg(F.sum("useful").alias("useful"))
    above = nodes[3].agg(F.least(F.lit(float(target)), F.coalesce(F.sum("useful"), F.lit(0.0))).alias("given"), F.lit(0).alias("root"))
    for depth in (1, 2, 3):
        parents = list(LEVELS[: depth - 1]) or ["root"]
        level = nodes[depth].select("*", weights.column(depth).alias("weight"), F.lit(0).alias("root"))
        equal = level.filter("weight > 0").groupBy(*parents, (F.col("useful") / F.col("weight")).alias("per_weight")).agg(F.sum("useful").alias("useful"), F.sum("weight").alias("weight"))
        order = Window.partitionBy(*parents).orderBy("per_weight")
        before = F.coalesce(F.sum("useful").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        behind = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        steps = equal.select(*parents, before.alias("before"), behind.alias("behind")).join(above, parents)
        fill = steps.groupBy(*parents).agg(F.greatest(F.max((F.col("given") - F.col("before")) / F.col("behind")), F.lit(0.0)).alias("fill"))
        level = level.join(fill, parents, "left")
        above = level.select(*LEVELS[:depth], F.coalesce(F.least("useful", F.col("weight") * F.col("fill")), F.lit(0.0)).alias("given"))
    return leaves.join(above.withColumnRenamed("given", "budget"), list(LEVELS))


def _tree(docs: DataFrame, domain: Column, language: str, source: str) -> list[Column]:
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return [name(domain).alias("domain"), name(F.col(language)).alias("language"), name(F.col(source)).alias("source")]


def _small(leaves: DataFrame) -> DataFrame:
    """Leaves to join to: broadcast only if they have been counted to be few."""
    return F.broadcast(leaves) if leaves.count() <= MOST_LEAVES else leaves


def cuts(rows: DataFrame, target: float, weights: Weights, *, max_epochs: int, seed: int) -> DataFrame:
    """What each leaf selects, from ``rows`` (domain, language, source, id, tokens).

    ``epochs`` whole ones, and of the next the ranges below ``range`` of ``ranges``
    and in that one the documents up to (``cut_place``, ``cut_id``).
    """
    keys = list(LEVELS)
    leaves = rows.groupBy(*keys).agg(F.sum("tokens").alias("supply"), F.count(F.lit(1)).alias("rows"))
    leaves = written(leaves.select("*", (F.col("supply") * max_epochs).cast("double").alias("capacity")), "leaves")
    plan = allocate(leaves, target, weights)
    budget = F.round(F.col("budget")).cast("long")
    whole = F.least(F.coalesce(F.floor(F.try_divide(budget, F.col("supply"))), F.lit(0)), F.lit(max_epochs)).cast("long")
    plan = plan.select(*keys, "supply", "rows", budget.alias("budget"), whole.alias("epochs"))
    plan = plan.select("*", (F.col("budget") - F.col("epochs") * F.col("supply")).alias("rest"), F.ceil(F.col("rows") / RANGE).cast("long").alias("ranges"))
    plan = written(plan, "budgets")
    placed = rows.join(_small(plan.filter("rest > 0").select(*keys, "epochs", "rest", "ranges")), keys)
    placed = placed.select("*", position(F.col("epochs"), seed, F.col("id")).alias("place"))
    placed = placed.select("*", range_of(F.col("place"), F.col("ranges")).alias("range"))
    sums = placed.groupBy(*keys, "range").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    running = Window.partitionBy(*keys).orderBy("range")
    sums = sums.select("*", (F.sum("tokens").over(running) - F.col("tokens")).alias("before"))
    edge = sums.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest"))).select(*keys, "range", "before")
    edge = written(edge.groupBy(*keys).agg(F.min_by(F.struct("range", "before"), "range").alias("edge")).select(*keys, "edge.range", "edge.before"), "edges")
    inside = placed.join(_small(edge), [*keys, "range"])
    order = Window.partitionBy(*keys).orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.select("*", (F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0))).alias("until"))
    cut = inside.filter("until < rest").groupBy(*keys).agg(F.max(F.struct("place", "id")).alias("cut"))
    out = plan.join(edge, keys, "left").join(cut, keys, "left")
    return written(out.select(*plan.columns, F.coalesce("range", F.lit(-1)).alias("range"), F.col("cut.place").alias("cut_place"), F.col("cut.id").alias("cut_id")), "cuts")


def range_of(place: Column, ranges: Column) -> Column:
    """Which of ``ranges`` equal parts of all places a place is in."""
    return F.floor(F.shiftright(place, 31) * ranges / 2.0**31).cast("long")


def select_mix(
    docs: DataFrame,
    weights: Weights = Weights(),
    *,
    target_share: float | None = None,
    target_tokens: float | None = None,
    domain: Column | None = None,
    doc_id: str = "doc_id",
    language: str = "lang",
    source: str = "source",
    text: str = "text",
    max_epochs: int = 1,
    seed: int = 7,
) -> DataFrame:
    """``docs`` that are selected, with ``copies``: the number of epochs that take each.

    The target is a number of tokens or a share of those there are.
    """
    if (target_share is None) == (target_tokens is None):
        raise ValueError("give target_share or target_tokens")
    tree = _tree(docs, domain if domain is not None else source_domain(source), language, source)
    ident = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    rows = written(docs.select(*tree, ident.alias("id"), token_count(text).alias("tokens")), "tokens")
    if target_tokens is None:
        target_tokens = target_share * (rows.agg(F.sum("tokens")).first()[0] or 0)
    chosen = cuts(rows, target_tokens, weights, max_epochs=max_epochs, seed=seed)
    leaf_name, cut_name, place_name = (fresh(docs, x) for x in ("_leaf", "_cut", "_place"))
    leaf = chosen.select(F.struct(*LEVELS).alias(leaf_name), F.struct("epochs", "ranges", "range", "cut_place", "cut_id").alias(cut_name))
    both = docs.select("*", F.struct(*tree).alias(leaf_name)).join(_small(leaf), leaf_name)
    cut = lambda name: F.col(cut_name)[name]
    both = both.select("*", position(cut("epochs"), seed, ident).alias(place_name))
    place = F.col(place_name)
    at, edge = range_of(place, cut("ranges")), cut("range")
    prefix = (at < edge) | ((at == edge) & ((place < cut("cut_place")) | ((place == cut("cut_place")) & (ident <= cut("cut_id")))))
    copies = (cut("epochs") + F.coalesce(prefix.cast("long"), F.lit(0))).cast("int").alias("copies")
    return both.select(*(c for c in docs.columns if c.lower() != "copies"), copies).filter("copies > 0")


#: Weights of the query: two domains above the others, English below its share, and one source above its siblings.
QUERY_WEIGHTS = Weights({("domain0",): 2.0, ("domain1",): 3.0, ("domain0", "en"): 0.5, ("domain1", "es"): 4.0, ("domain1", "en", "src1"): 2.0})


def op7_source_mix(docs: DataFrame) -> DataFrame:
    """Ids, leaf and copies of what is selected for half of all tokens, with up to three epochs."""
    out = select_mix(docs, QUERY_WEIGHTS, target_share=0.5, max_epochs=3)
    return out.select("doc_id", source_domain().alias("domain"), "lang", "source", "copies")
