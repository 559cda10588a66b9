"""Sharding by global prefix sums of byte sizes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspan.llm.common import checkpointed

#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: Key ranges whose totals meet in one small table: so many, and one for each PER_RANGE rows where those are more, so no range grows with the input.
RANGES, PER_RANGE = 4096, 1 << 18
#: Pieces into which the rows of one text are dealt.
SALTS = 64


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def shard_by_bytes(docs: DataFrame, shards: int = 40, ranges: int = RANGES, salts: int = SALTS, keep: float = 0.01) -> DataFrame:
    """Deal documents (doc_id, text) into contiguous shards of nearly equal bytes.

    Rows are laid out in the order (text_crc32, salt, doc_id), so that copies lie together; the salt is a checksum of the doc_id. The texts are read
    once, and leave a checkpoint of four numbers a row. Three levels of totals give each row its global byte offset without any global sort: totals of the
    key ranges (a row a range, so one task may sum them up), totals of (crc, salt) pieces inside
    a range, and a running sum inside a piece. A text that holds a third of all rows is spread over
    `salts` pieces. The shard is the equal-size interval of the total in which the row's bytes begin;
    equal texts of less than `keep` of a shard follow their first row, so they stay together, and a larger
    group is cut wherever the target falls. A shard's size is thus within a row, or `keep`, of the target.

    Null text counts as no bytes (crc of the empty string); a null doc_id sorts first; equal rows get
    slots in any order. An empty table gives no rows. Other columns are ignored.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law `bytes` promises nothing
    about one more shard).
    """
    rows = checkpointed(
        docs.select(
            "doc_id",
            text_bytes(F.col("text")).alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(salts)).cast("int").alias("salt"),
        )
    )
    ranges = max(ranges, rows.count() // PER_RANGE)
    pieces = (
        rows.groupBy("text_crc32", "salt")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        .withColumn("range", F.floor(F.col("text_crc32") * ranges / (1 << 32)).cast("int"))
    )
    one = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        pieces.groupBy("range")
        .agg(F.sum("bytes").alias("rb"), F.sum("n").alias("rn"))
        .select(
            "range",
            F.coalesce(F.sum("rb").over(one), F.lit(0)).alias("range_bytes"),
            F.coalesce(F.sum("rn").over(one), F.lit(0)).alias("range_rows"),
            F.sum("rb").over(Window.partitionBy(F.lit(0))).alias("all_bytes"),
        )
    )
    inside = Window.partitionBy("range").orderBy("text_crc32", "salt").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("range", "text_crc32")
    offsets = (
        pieces.withColumn("before_bytes", F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
        .withColumn("before_rows", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .withColumn("group_bytes", F.sum("bytes").over(group))
        .withColumn("group_start", F.min("before_bytes").over(group))
        # four numbers a range
        .join(F.broadcast(totals), "range")
        .select(
            "text_crc32",
            "salt",
            (F.col("before_bytes") + F.col("range_bytes")).alias("before_bytes"),
            (F.col("before_rows") + F.col("range_rows")).alias("before_rows"),
            F.when(F.col("group_bytes") * shards <= F.col("all_bytes") * keep, F.col("group_start") + F.col("range_bytes")).alias("whole_at"),
            "all_bytes",
        )
    )
    piece = Window.partitionBy("text_crc32", "salt").orderBy("doc_id")
    run = piece.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.join(offsets, ["text_crc32", "salt"])
        .withColumn("at", F.col("before_bytes") + F.coalesce(F.sum("size").over(run), F.lit(0)))
        .withColumn("rank", F.col("before_rows") + F.row_number().over(piece) - 1)
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, (coalesce(whole_at, at) * {shards}) div all_bytes) as int)"))
    )
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The same by plain prefix sums over the whole order, for DuckDB. CRC-32 goes by its table of 256 remainders, made from the polynomial.
SHARD_SQL = """
WITH bits AS (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(n)
), crc AS (
    SELECT list(c ORDER BY n) AS t FROM bits
), bytes AS (
    SELECT doc_id, text, octet_length(encode(coalesce(text, ''))) + 16 AS size,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST(CAST('0x' || h AS INT) AS BIGINT)) AS b,
        list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), ''))), '..'), lambda h: CAST(CAST('0x' || h AS INT) AS BIGINT)) AS d
    FROM documents
), docs AS (
    SELECT doc_id, size,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS text_crc32,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), d), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 64 AS salt
    FROM bytes, crc
), laid AS (
    SELECT *, sum(size) OVER w - size AS off, row_number() OVER w - 1 AS place, sum(size) OVER () AS total FROM docs WINDOW w AS (ORDER BY text_crc32, salt, doc_id NULLS FIRST)
), grouped AS (
    SELECT *, sum(size) OVER (PARTITION BY text_crc32) AS own, min(off) OVER (PARTITION BY text_crc32) AS head FROM laid
), placed AS (
    SELECT *, CAST(least(39, (CASE WHEN own * 40 <= total * 0.01 THEN head ELSE off END * 40) // total) AS INT) AS shard FROM grouped
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed
"""
