"""A reproducible shuffle into shards: a Feistel permutation over global row numbers.

Every row gets a global number 0 .. N-1, the number is permuted by a keyed Feistel network, and the
permuted position p gives shard ``p mod n`` and slot ``p div n``. Shards therefore differ by one row
at most and the slots of a shard have no gaps (law ``rows``). Where a row goes can be computed from
its number alone, without the data.

*Numbers.* Rows are ordered by (bucket, doc_id, checksum, size), bucket being a hash of doc_id and the
text's checksum, so that rows of one doc_id, or without any, do not meet in one task unless their texts
are equal too. One pass counts the buckets; a row's number is its bucket's offset plus its rank in the
bucket. No global sort and no sampled boundary is involved, so reruns agree.

*Permutation.* The network works on pairs (l, r) with l < a and r < b, where a * b >= N. The factors
are chosen so that a * b - N is as small as can be. A value that falls at or above N is permuted
again until it is below N (cycle walking). A walk visits each of the a * b - N values above N once
at most, which bounds it, so the expression needs no open loop.

Defined results: null and empty texts have size 8 and checksum 0; rows without doc_id are dealt like
others; very long texts count by their size only; repeated rows get positions of their own; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternq.llm.common import text_or_empty

SHARDS = 24
SEED = 20240229
#: Buckets of row numbers: the only thing gathered on the driver is one count for each.
BUCKETS = 16_384
ROUNDS = 6
#: Odd multipliers below 2**31 for the round function.
MULTIPLIERS = (1597334677, 2147001325)


def factors(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n, a between sqrt(n) and 2 sqrt(n), and the least a * b - n."""
    root = max(1, int(max(n, 1) ** 0.5))
    return min(((a, -(-n // a)) for a in range(root, 2 * root + 2)), key=lambda ab: (ab[0] * ab[1] - n, ab[0])) if n else (1, 1)


def keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """31 bits of key for each round; bit 31 tells which half the round changes."""
    return [(seed * 48271 + (i + 1) * 69621) % 2147483647 + (i % 2) * 2147483648 for i in range(rounds)]


def _mixed(x: Column, key: Column) -> Column:
    """A round's function: 31 bits of a product, folded and multiplied again. Fits 63 bits for x below 2**31."""
    y = (x * MULTIPLIERS[0] + key) % 2147483648
    return F.shiftright(((y + F.shiftright(y, 15)) * MULTIPLIERS[1]) % 2147483648, 7)


def permuted(position: Column, n: int, seed: int = SEED) -> Column:
    """The place of ``position`` (0 .. n-1) in a keyed permutation of 0 .. n-1."""
    a, b = (F.lit(x).cast("long") for x in factors(n))
    walks = factors(n)[0] * factors(n)[1] - n
    network = F.array(*[F.lit(k).cast("long") for k in keys(seed)])

    def changed(v: Column, key: Column) -> Column:
        r = v % b
        left = ((v - r) / b).cast("long")
        return F.when(key < 2147483648, ((left + _mixed(r, key)) % a) * b + r).otherwise(left * b + (r + _mixed(left, key % 2147483648)) % b)

    def once(x: Column) -> Column:
        return F.aggregate(network, x, changed)

    first = once(position.cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first, lambda x, _: F.when(x < n, x).otherwise(once(x))) if walks else first


def _checksum() -> Column:
    return F.crc32(F.encode(text_or_empty(), "UTF-8"))


def _bucket(buckets: int) -> Column:
    name = F.concat_ws("/", F.col("doc_id").cast("string"), _checksum().cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % buckets


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is ``rows``) of every row."""
    counts = dict(docs.groupBy(_bucket(buckets).alias("b")).count().collect())
    offsets, n = [], 0
    for b in range(buckets):
        offsets.append(n)
        n += counts.get(b, 0)
    start = F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<bigint>")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        _checksum().alias("text_crc32"),
        _bucket(buckets).alias("b_"),
    )
    rank = F.row_number().over(W.partitionBy("b_").orderBy("doc_id", "text_crc32", "size"))
    rows = rows.withColumn("n_", F.get(start, F.col("b_").cast("int")) + rank - 1)
    rows = rows.withColumn("p_", permuted(F.col("n_"), n, seed))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("p_") % shards).cast("int").alias("shard"),
        F.floor(F.col("p_") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


_MIX = "((({0}) * {m1} + {1}) % 2147483648 + ((({0}) * {m1} + {1}) % 2147483648 >> 15)) * {m2} % 2147483648 >> 7"


def _once_sql(x: str) -> str:
    mix = lambda v, k: "(" + _MIX.format(v, k, m1=MULTIPLIERS[0], m2=MULTIPLIERS[1]) + ")"
    one = f"((v // b + {mix('v % b', 'k')}) % a) * b + v % b"
    two = f"v // b * b + (v % b + {mix('v // b', 'k % 2147483648')}) % b"
    return f"list_reduce([{', '.join(f'{k}::BIGINT' for k in keys(SEED))}], lambda v, k: CASE WHEN k < 2147483648 THEN {one} ELSE {two} END, {x})"


SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) AS t(i))),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
h0 AS MATERIALIZED (SELECT doc_id, (length(x) // 2 + 8)::BIGINT AS size,
  xor(list_reduce(list_transform(range(length(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT),
    lambda c, y: xor(c >> 8, tab[xor(c & 255, y) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM d, crc),
h AS MATERIALIZED (SELECT *, ('0x' || substr(md5(concat_ws('/', doc_id::VARCHAR, text_crc32::VARCHAR)), 1, 8))::BIGINT % {BUCKETS} AS b_ FROM h0),
c AS (SELECT count(*)::BIGINT AS n, greatest(1, floor(sqrt(count(*))))::BIGINT AS s FROM h),
f AS MATERIALIZED (SELECT n, a, (n + a - 1) // a AS b FROM c, unnest(range(s, 2 * s + 2)) AS t(a) ORDER BY (n + a - 1) // a * a - n, a LIMIT 1),
r AS MATERIALIZED (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY b_, doc_id NULLS FIRST, text_crc32, size) - 1 AS i FROM h),
w AS (SELECT i, n, a, b, {_once_sql('i')} AS p FROM r, f
  UNION ALL SELECT i, n, a, b, {_once_sql('p')} FROM w WHERE p >= n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {SHARDS})::INTEGER AS shard, p // {SHARDS} AS slot, NULL::INTEGER AS grown_shard
FROM w JOIN r USING (i) WHERE p < n
"""
