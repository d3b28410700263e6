"""Shards by rendezvous hashing: every record key draws a cost at every shard and goes to the cheapest.

The cost is -ln(u) / weight with u from a hash of key and shard, so a shard's share of
the keys is its weight's share, and costs at other shards don't depend on which shards
there are. One more shard takes only the keys that are cheaper there, from all others
alike; a shard that leaves hands its keys to all others; a changed weight moves keys
only to or from that shard. The hash is MD5, the same in every engine and version.

Slots number a shard's records in the order of a hash of key, size and checksum, which
shuffles them. That order is cut into ranges that are counted first, so no task orders
a whole shard.

Edge cases: a null key counts as an empty one, and all rows of a key are in one shard,
whatever their number (that is what a stable key means); their slots are still given
range by range, as size and checksum take part, and equal rows are counted once and
dealt out again. A null text is empty. An empty table gives no rows. A column that is
named like an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import repeated, text_or_empty, written

#: Bits of a hash that a double holds exactly.
BITS = 52
#: Rows of a shard that a task orders at once.
RANGE_ROWS = 8192


def place(key: Column) -> Column:
    """The first 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _key(key: str | Column) -> Column:
    return F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))


def cheapest(key: str | Column, shards: Mapping[int, float]) -> Column:
    """Struct of cost and shard; equal costs go to the smaller number, shards of weight 0 get nothing."""
    if any(not 0 <= w < float("inf") for w in shards.values()) or not any(shards.values()):
        raise ValueError("weights are finite and not negative, and one is above 0")
    open_shards = F.array(*(F.struct(F.lit(int(s)).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(shards.items()) if w))
    cost = lambda s: -F.ln((place(F.concat_ws(":", s["shard"].cast("string"), _key(key))) + 0.5) / 2.0**BITS) / s["weight"]
    return F.array_min(F.transform(open_shards, lambda s: F.struct(cost(s).alias("cost"), s["shard"].alias("shard"))))


def assign(rows: DataFrame, shards: Mapping[int, float], *, key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """``rows`` with their shard: a projection, nothing is shuffled."""
    return rows.withColumn(shard, cheapest(key, shards)["shard"])


def moves(rows: DataFrame, before: Mapping[int, float], after: Mapping[int, float], *, key: str = "doc_id") -> DataFrame:
    """from_shard, to_shard, n_rows: what a change of shards or weights moves and what stays."""
    pairs = rows.select(cheapest(key, before)["shard"].alias("from_shard"), cheapest(key, after)["shard"].alias("to_shard"))
    return pairs.groupBy("from_shard", "to_shard").agg(F.count("*").alias("n_rows"))


def write_shards(rows: DataFrame, path: str, shards: Mapping[int, float], *, key: str = "doc_id", parts: int = 8, rows_per_file: int = 1_000_000) -> None:
    """Parquet folders ``shard=n``. Each shard is written by ``parts`` tasks at most, dealt by all of its columns that can be hashed."""
    sharded = assign(rows, shards, key=key)
    plain = [F.col(f"`{f.name}`") for f in rows.schema if f.dataType.typeName() not in ("map", "variant")]
    part = F.pmod(F.xxhash64(*plain), F.lit(parts))
    sharded.repartition(len(shards) * parts, "shard", part).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def with_slots(counted: DataFrame, columns: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``columns`` and ``slot``, from 0 without gaps in each shard.

    ``counted`` is a written table of different rows with ``times``, ``shard`` and ``place``.
    """
    ranges = (counted.agg(F.sum("times")).first()[0] or 0) // (range_rows * max(1, counted.select("shard").distinct().count())) + 1
    rows = counted.withColumn("range", F.floor(F.col("place") * (ranges / 2.0**BITS)).cast("long"))
    before = rows.groupBy("shard", "range").agg(F.sum("times").alias("n"))
    before = before.select("shard", "range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("before"))
    order = Window.partitionBy("shard", "range").orderBy("place", *columns).rowsBetween(Window.unboundedPreceding, 0)
    first = rows.join(before, ["shard", "range"]).withColumn("first", F.col("before") + F.sum("times").over(order) - F.col("times"))
    return repeated(first, "times", "copy").select(*columns, (F.col("first") + F.col("copy")).alias("slot"))


#: Of the query: sixteen shards, the last four on larger machines, and the one that may be added.
QUERY_SHARDS = {n: 1.0 if n < 12 else 1.25 for n in range(16)}
QUERY_GROWN = QUERY_SHARDS | {16: 1.0}


def op12_sharding(docs: DataFrame) -> DataFrame:
    """Shard and slot of every document, and its shard if there was one more."""
    text = text_or_empty()
    digests = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = digests.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("times"))
    best = counted.select("*", cheapest("doc_id", QUERY_SHARDS).alias("best"), cheapest("doc_id", {16: QUERY_GROWN[16]}).alias("added"))
    placed = best.select(
        *counted.columns,
        F.col("best.shard").alias("shard"),
        F.least("best", "added")["shard"].alias("grown_shard"),
        place(F.concat_ws(":", _key("doc_id"), F.col("size").cast("string"), F.col("text_crc32").cast("string"))).alias("place"),
    )
    columns = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    out = with_slots(written(placed, "placed"), columns)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def oracle_sql() -> str:
    return r"""
WITH crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS k),
hexed AS (SELECT text, hex(encode(text)) AS x FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)),
sums AS MATERIALIZED (
  SELECT text, length(x) // 2 + 1 AS size, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, k[(xor(c, b) & 255) + 1]), 4294967295)) AS text_crc32
  FROM hexed, crc_table),
costs AS (
  SELECT doc_id, s::INT AS shard, -ln((('0x' || substr(md5(s || ':' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / CASE WHEN s BETWEEN 12 AND 15 THEN 1.25::DOUBLE ELSE 1::DOUBLE END AS cost
  FROM (SELECT DISTINCT doc_id FROM documents), range(17) AS r(s)),
best AS (SELECT doc_id, arg_min(shard, cost) FILTER (shard < 16) AS shard, arg_min(shard, cost) AS grown_shard FROM costs GROUP BY doc_id)
SELECT d.doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(concat_ws(':', coalesce(d.doc_id::VARCHAR, ''), size, text_crc32)), 1, 13))::BIGINT, d.doc_id, size, text_crc32) - 1 AS slot,
  grown_shard
FROM documents d JOIN sums ON sums.text = coalesce(d.text, '') JOIN best ON best.doc_id IS NOT DISTINCT FROM d.doc_id"""
