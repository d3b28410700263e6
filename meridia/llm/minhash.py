"""MinHash near-dedup: BagMinHash signatures of word shingles, banded, then verified.

A document is the bag of its five-word shingles (lower-cased words between white
space; of fewer words, all together are one shingle). Two documents are linked if the
Jaccard similarity of their bags, minima of counts over maxima, is 0.8 or more, and a
class is a connected component of links. Texts that are equal are one class anyway.

*Signatures.* The weight axis is discretised to whole counts and split into dyadic
cells [0, 1), [1, 2), [2, 4), [4, 8) ... Each (shingle, cell) has a Poisson process of
points in time, at a rate of the cell's length; each point falls on a place in the cell
and on a component. A bag of weight w sees the points below w. A component keeps its
earliest point, so two bags agree there with the probability of their weighted Jaccard
similarity, exactly. Points are made in rounds up to a time by which every component
has one almost surely; a text for which one is missing is given more time.

*Candidates.* Equal texts are one representative. 160 components make 32 bands of 5.
A pair is a candidate if it shares a band and agrees on ``least_agreement`` of all
components, in small buckets and large ones alike. A pair at 0.8 fails the first with a
probability of 3, the second of 6 in a million. Each bucket is
first compared to its most central member, the one that meets most others over all
buckets, so that a group of near copies has few leaders. Components of verified links are built. What is
left are pairs in one bucket and in different components. Small buckets give all such
pairs. Large ones join to families, whose signatures are dealt to blocks; each pair of
blocks is one bounded task, which finds the members that have a candidate in another
component. Their texts follow, and one more task a pair of blocks verifies what is not
connected yet and returns a spanning forest. So no candidate is passed over unless its
class is whole without it, and rows grow with documents, not with pairs.

*Exactness.* Similarities are computed from whole texts, with 64-bit shingle hashes.

Edge cases: a document without words (null, empty or white space) is only equal to the
same text, null to null and to empty. A null id has a null class and is never a
partner. Rows that repeat an id are one document; if their texts differ, it joins their
classes. The smallest id of a class names it. ``keep_one`` keeps a text of each class of
texts, so what such a document joins stays. An empty table gives an
empty result. Very long texts are one row like others. Only the named columns are read;
``keep_one`` passes all others on, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import fresh, lean, text_or_empty, written

SPACE = "[ \\x09-\\x0D]+"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 5
    small_bucket: int = 16  # members up to which a bucket gives pairs
    block: int = 512  # members of a block, about
    least_agreement: float = 0.66  # of signatures, 4.4 standard errors below 0.8
    most_bitmaps: int = 16_384  # of 4 kB and 32,768 bits each, to keep texts without candidates out of a shuffle

    @property
    def components(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        return math.floor(self.least_agreement * self.components)


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of each lower-cased word, in order."""
    return F.transform(F.array_remove(F.split(F.lower(text), SPACE), ""), lambda w: F.xxhash64(w))


def content_of(text: Column) -> Column:
    """A digest that only equal texts share."""
    return F.unhex(F.sha2(text, 256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle; ``words`` of all documents, from offset to offset."""
    lengths = np.diff(offsets)
    n = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    doc = np.repeat(np.arange(len(n)), n)
    if not len(doc):
        return doc, np.zeros(0, np.uint64)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    end = offsets[1:][doc]
    out = np.zeros(len(doc), np.uint64)
    last = len(words) - 1
    for k in range(size):
        inside = at + k < end
        out += np.where(inside, words[np.minimum(at + k, last)] * _ODD[k % 5] + np.uint64(k + 1), np.uint64(0))
        out = mix(out)
    return doc, out


def bags(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of each distinct shingle of each document, sorted."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def _points(doc, item, weight, until, m) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slot, time, identity) of the points that each document's bag sees up to its time."""
    top = int(weight.max(initial=1))
    low, length, cell = 0.0, 1.0, 0
    while low < top:
        sees = weight > low
        d, h, w = doc[sees], item[sees], weight[sees]
        t, r = np.zeros(len(d)), 0
        while len(d):
            seed = mix(h + np.uint64(((cell << 32) + r) * int(_ODD[1]) & 0xFFFFFFFFFFFFFFFF))
            u = ((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            t = t - np.log(u) / length
            live = t <= until[d]
            d, h, w, t, seed = d[live], h[live], w[live], t[live], seed[live]
            other = mix(seed ^ _ODD[2])
            place = low + length * ((mix(other) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            hit = place < w
            yield d[hit] * m + ((other >> np.uint64(32)) % np.uint64(m)).astype(np.int64)[hit], t[hit], (other & np.uint64(0xFFFF)).astype(np.uint16)[hit]
            r += 1
        low, length, cell = low + length, (length if cell == 0 else 2 * length), cell + 1


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs rows of m 16-bit identities of earliest points; rows of empty bags are 0."""
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    best, value = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint16)
    todo, extra = total > 0, 3.0
    while todo.any():
        until = np.where(todo, m * (math.log(m) + extra) / np.maximum(total, 1), -1.0)
        mine = todo[doc]
        for slot, t, identity in _points(doc[mine], item[mine], weight[mine], until, m):
            np.minimum.at(best, slot, t)
            won = t == best[slot]
            value[slot[won]] = identity[won]
        todo = todo & np.isinf(best.reshape(n_docs, m)).any(axis=1)
        extra *= 4
    return value.reshape(n_docs, m)


def _parts(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with ``most`` words together, or one row."""
    ends, at = lengths.cumsum(), 0
    while at < len(lengths):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def sign(hashed: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, content, n, sig): shingles counted with repeats, signature as bytes, null where n is 0."""
    m = settings.components

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(2)
            for a, b in _parts(np.diff(words.offsets.to_numpy()), 400_000):
                part = words.slice(a, b - a)
                offsets = part.offsets.to_numpy().astype(np.int64)
                flat = words.values.to_numpy().view(np.uint64)[offsets[0] : offsets[-1]]
                doc, item, count = bags(*shingles(flat, offsets - offsets[0], settings.shingle))
                n = np.bincount(doc, weights=count, minlength=b - a).astype(np.int64)
                sig = signatures(doc, item, count, b - a, m)
                raw = [x.tobytes() if k else None for x, k in zip(sig, n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(raw, pa.binary())], names=["doc_id", "content", "n", "sig"]
                )

    return hashed.mapInArrow(lean(work), "doc_id long, content binary, n long, sig binary")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of edges (a, b): the smallest id that it is connected to.

    Each round maps a node to that of itself and its neighbours whose hash is least, and
    contracts the graph to these; the random order shrinks any graph, chains too, by a
    constant factor a round, until no edge is left. A star is gone after one round.
    """
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels = left.select(F.col("a").alias("id"), F.col("b").alias("label")).limit(0)
    first = True
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        best = both.groupBy(F.col("a").alias("id")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("label"))).alias("best"))
        own = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("label"))
        step = written(best.select("id", F.least(own, "best")["label"].alias("label")), "step")
        if first:
            labels, first = step, False
        else:
            further = step.select(F.col("id").alias("label"), F.col("label").alias("further"))
            labels = written(labels.join(further, "label", "left").select("id", F.coalesce("further", "label").alias("label")), "labels")
        moved = left.join(step.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(step.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
        left = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "edges")
    smallest = labels.groupBy("label").agg(F.min("id").alias("smallest"))
    return written(labels.join(smallest, "label").select("id", F.col("smallest").alias("label")), "labels")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags (sorted hashes, counts)."""
    small, large = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not len(small[0]):
        return 0.0
    at = np.minimum(np.searchsorted(large[0], small[0]), len(large[0]) - 1)
    same = large[0][at] == small[0]
    shared = float(np.minimum(small[1][same], large[1][at[same]]).sum())
    return shared / (float(a[1].sum() + b[1].sum()) - shared)


def bag(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of one document and their counts."""
    _, item, count = bags(*shingles(words.view(np.uint64), np.array([0, len(words)]), size))
    return item, count


def candidates(one: np.ndarray, two: np.ndarray, settings: Settings) -> np.ndarray:
    """For signatures in rows (``one`` may be a single one): who agrees on enough components and on a whole band."""
    same = one == two
    out = same.sum(axis=-1) >= settings.least_equal
    out[out] = same[out].reshape(-1, settings.bands, settings.rows).all(axis=2).any(axis=1)
    return out


def verified(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Those of pairs (a, b) that are candidates and whose similarity is enough. ``texts``: id, text, sig."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left"), F.col("sig").alias("s")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right"), F.col("sig").alias("t")), "b")
    both = both.select("a", "b", word_hashes(F.col("left")).alias("left"), word_hashes(F.col("right")).alias("right"), "s", "t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = [np.stack([np.frombuffer(x.as_py(), np.uint16) for x in batch.column(k)]) for k in (4, 5)]
            kept = candidates(*sigs, settings)
            columns = [(x.offsets.to_numpy(), x.values.to_numpy()) for x in (batch.column(2), batch.column(3))]
            for i in np.flatnonzero(kept):
                one, two = (bag(v[o[i] : o[i + 1]], settings.shingle) for o, v in columns)
                kept[i] = similarity(one, two) >= settings.similarity
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return both.mapInArrow(lean(work), "a long, b long")


class Forest:
    """Union-find over small numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def block_candidates(group: pd.DataFrame, settings: Settings) -> list[tuple[int, int, int]]:
    """(components in disagreement, row, row) of candidates within a block, or between two, in different components."""
    if not len(group):
        return []
    sig = np.stack([np.frombuffer(x, np.uint16) for x in group["sig"]])
    block, n, label = group["block"].to_numpy(), group["n"].to_numpy(), group["label"].to_numpy()
    two_blocks = group["p"].iloc[0] != group["q"].iloc[0]
    found: list[tuple[int, int, int]] = []
    for i in range(len(group) - 1):
        rest = np.arange(i + 1, len(group))
        rest = rest[(label[rest] != label[i]) & (np.minimum(n[rest], n[i]) >= settings.similarity * np.maximum(n[rest], n[i]))]
        if two_blocks:
            rest = rest[block[rest] != block[i]]
        rest = rest[candidates(sig[rest], sig[i], settings)]
        found += [(settings.components - int(k), i, int(j)) for k, j in zip((sig[rest] == sig[i]).sum(axis=1), rest, strict=True)]
    return found


def block_links(group: pd.DataFrame, settings: Settings) -> list[tuple[int, int]]:
    """Links within a block, or between two, that connect what ``label`` doesn't: a spanning forest."""
    group = group.sort_values("id", ignore_index=True)
    forest = Forest(len(group))
    for same in group.groupby("label").indices.values():
        for i in same[1:]:
            forest.join(int(same[0]), int(i))
    ids = group["id"].to_numpy()
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out = []
    for _, i, j in sorted(block_candidates(group, settings)):
        if forest.root(i) != forest.root(j):
            for k in (i, j):
                if k not in known:
                    known[k] = bag(np.asarray(group["words"].iloc[k], dtype=np.int64), settings.shingle)
            if similarity(known[i], known[j]) >= settings.similarity:
                forest.join(i, j)
                out.append((int(ids[i]), int(ids[j])))
    return out


def bucket_rows(reps: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, id, n) of each band of each representative, in buckets of two or more."""
    width = 2 * settings.rows
    bands = F.transform(F.sequence(F.lit(0), F.lit(settings.bands - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * width + 1, F.lit(width))))
    return reps.filter("sig IS NOT NULL").select("id", "n", F.explode(bands).alias("bucket"))


def likely_in(rows: DataFrame, ids: DataFrame, bitmaps: int, column: str = "id") -> DataFrame:
    """Rows whose ``column`` may be in ``ids``: all that are, and some others.

    One bit an id, in so many bitmaps of 4 kB: what is broadcast has this size at most,
    however many ids there are. With as many ids as bits most rows are kept.
    """
    h = F.xxhash64(column)
    number = F.pmod(h, F.lit(bitmaps)).alias("_bitmap")
    position = F.pmod(F.shiftrightunsigned(h, 20), F.lit(32768))
    maps = ids.select(number, position.alias("p")).groupBy("_bitmap").agg(F.bitmap_construct_agg("p").alias("_bits"))
    byte = F.conv(F.hex(F.col("_bits").substr(F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("_bitmap", number).join(F.broadcast(maps), "_bitmap")
    return held.filter(F.getbit(byte, (position % 8).cast("int")) == 1).select(*rows.columns)


def _linked(docs: DataFrame, settings: Settings, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents, their signatures, their distinct texts and the links of these."""
    whole = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    hashed = whole.filter("doc_id IS NOT NULL").select("doc_id", content_of(F.col("text")).alias("content"), word_hashes(F.col("text")).alias("words"))
    signed = written(sign(hashed, settings), "signatures")
    # equal texts are one representative, with a number of its own: an id may have several texts
    copies = signed.groupBy("content").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    copies = written(copies.withColumn("id", F.monotonically_increasing_id()), "representatives")
    return whole, signed, copies, written(_links(copies, whole, settings), "links")


def _labels(copies: DataFrame, links: DataFrame) -> DataFrame:
    """(content, doc, label) of each text that has copies or links, labels being those of classes."""
    both = copies.join(components(links), "id", "left").filter("copies > 1 OR label IS NOT NULL")
    return both.select("content", "doc", F.coalesce("label", "id").alias("label"))


def classes(docs: DataFrame, settings: Settings = Settings(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id): the smallest id of each document's class."""
    whole, signed, copies, links = _linked(docs, settings, key, text)
    # an id with several texts links them
    again = signed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id")
    again = signed.select("doc_id", "content").join(again, "doc_id").distinct().join(copies.select("content", "id"), "content").groupBy("doc_id")
    again = again.agg(F.min("id").alias("a"), F.collect_set("id").alias("ids")).filter(F.size("ids") > 1).select("a", F.explode("ids").alias("b"))
    known = written(_labels(copies, links.unionByName(again.filter("a <> b"))), "labels")
    names = known.groupBy("label").agg(F.min("doc").alias("class_id"))
    named = known.join(names, "label").select("content", "class_id")
    out = signed.select("doc_id", "content").join(named, "content", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    out = out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    missing = whole.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(missing)


def _links(copies: DataFrame, whole: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): verified links that connect every class of different texts."""
    reps = copies.select("id", "n", "sig")
    rows = bucket_rows(reps, settings)
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = written(rows.join(sizes, "bucket").select("bucket", "id", "n", "size"), "buckets")
    central = rows.groupBy("id").agg(F.sum("size").alias("met"))
    leaders = rows.select("bucket", "id").join(central, "id").groupBy("bucket").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("first"))
    rows = written(rows.join(leaders, "bucket"), "buckets")
    likely = F.least("n", "m") >= settings.similarity * F.greatest("n", "m")
    stars = rows.filter("id <> first").select(F.least("first", "id").alias("a"), F.greatest("first", "id").alias("b")).distinct()
    involved = written(rows.select("id").distinct().join(copies.select("id", "doc", "content", "sig"), "id"), "involved")
    texts = whole.select(F.col("doc_id").alias("doc"), "text")
    n = involved.count()
    if n < 32768 * settings.most_bitmaps / 2:  # 64 bits an id as long as there is room for them
        texts = likely_in(texts, involved.select("doc"), min(settings.most_bitmaps, max(1, math.ceil(n / 512))), "doc")
    # an inner join, ids being distinct: a semi join would be pushed below the bitmaps
    texts = texts.join(involved, "doc").filter(content_of(F.col("text")) == F.col("content")).select("id", "text", "sig")
    texts = written(texts.dropDuplicates(["id"]), "texts")
    first = written(verified(stars, texts, settings), "links")
    labels = components(first)
    rows = rows.join(labels, "id", "left").select("bucket", "id", "n", "size", "first", F.coalesce("label", "id").alias("label"))
    # buckets that still hold more than one component
    torn = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    rows = written(rows.join(torn, "bucket", "left_semi"), "torn")
    small = rows.filter(F.col("size") <= settings.small_bucket)
    ends = F.collect_list(F.struct("id", "n", "label")).alias("members")
    pairs = small.groupBy("bucket").agg(ends).select(
        F.explode(
            F.flatten(
                F.transform(
                    "members",
                    lambda x: F.transform(F.filter("members", lambda y: (y["id"] > x["id"]) & (y["label"] != x["label"])), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b"), x["n"].alias("n"), y["n"].alias("m"))),
                )
            )
        ).alias("pair")
    )
    pairs = pairs.select("pair.*").filter(likely).select("a", "b").distinct()
    pairs = pairs.join(stars, ["a", "b"], "left_anti")
    second = written(verified(pairs, texts, settings), "links")
    large = rows.filter(F.col("size") > settings.small_bucket)
    # a node and its label say what the first links connect
    links = labels.select(F.col("label").alias("a"), F.col("id").alias("b")).unionByName(second)
    if not large.isEmpty():
        third = _family_links(large, reps, texts, settings)
        links = links.unionByName(third)
    return links.distinct()


def _family_links(large: DataFrame, reps: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Links among members of large buckets: families of overlapping buckets, compared block by block."""
    family = components(large.select(F.col("first").alias("a"), F.col("id").alias("b")).filter("a <> b").distinct()).select("id", F.col("label").alias("family"))
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("members")).select("family", F.ceil(F.col("members") / settings.block).cast("int").alias("blocks"))
    label = large.groupBy("id").agg(F.first("label").alias("label"))
    member = family.join(sizes, "family").join(label, "id").join(reps, "id")
    member = member.select("*", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    # each block meets itself and every other one once; only signatures travel to all of them
    dealt = member.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "family", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "label", "n", "sig"
    )
    kinds = "family long, p int, q int, block int, id long, label long, n long, sig binary"

    def find(group: pd.DataFrame) -> pd.DataFrame:
        return group.iloc[sorted({x for _, i, j in block_candidates(group, settings) for x in (i, j)})]

    def link(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(group, settings), columns=["a", "b"], dtype="int64")

    found = written(dealt.groupBy("family", "p", "q").applyInPandas(find, kinds), "candidates")
    found = found.join(texts.select("id", word_hashes(F.col("text")).alias("words")), "id")
    return written(found.groupBy("family", "p", "q").applyInPandas(link, "a long, b long"), "links")


def op3_near_dedup(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return classes(docs, settings)


def keep_one(docs: DataFrame, settings: Settings = Settings(), *, key: str = "doc_id") -> DataFrame:
    """``docs`` without the near copies of others: of each class of texts that of the smallest id stays, null ids too.

    Rows that repeat an id and its text become one.
    """
    _, signed, copies, links = _linked(docs, settings, key, "text")
    known = written(_labels(copies, links), "labels")
    first = known.groupBy("label").agg(F.min(F.struct("doc", "content")).alias("first"))
    first = known.join(first, "label").select("content", F.col("first.doc").alias("first_doc"), F.col("first.content").alias("first_content"))
    kept = signed.select("doc_id", "content").join(first, "content", "left").filter("first_doc IS NULL OR (doc_id = first_doc AND content = first_content)")
    name = fresh(docs, "_content")
    kept = kept.select(F.col("doc_id").alias(key), F.col("content").alias(name))
    rows = docs.filter(F.col(key).isNotNull()).withColumn(name, content_of(text_or_empty("text")))
    rows = rows.join(kept, [key, name], "left_semi").dropDuplicates([key, name])
    return rows.select(*docs.columns).unionByName(docs.filter(F.col(key).isNull()))
