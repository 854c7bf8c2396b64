"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size. Shards take turns, each
claiming its best slot that is still free, until the table is full; so shards hold equal numbers of slots to
within one, and a shard that joins or leaves moves few documents. The table has a fixed size (a parameter, not a
function of the data) and is broadcast: a document costs one hash and one probe, and no row is shuffled.

Null ids hash as the empty text; repeated ids get the same shard; an empty table gives no rows. Columns of the
input named slot or shard are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import doc_key, table, without

#: Production parameters: slots are prime and over 100 times the shards, so loads differ by under one percent.
SHARDS, SLOTS = 32, 4099


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """slot -> shard. Needs 1 <= shards <= slots and a prime number of slots."""
    if not 1 <= shards <= slots or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be prime and at least the number of shards")
    owner = [-1] * slots
    at = [_number(f"shard-{s}:offset") % slots for s in range(shards)]
    skip = [_number(f"shard-{s}:skip") % (slots - 1) + 1 if slots > 2 else 1 for s in range(shards)]
    for turn in range(slots):
        s = turn % shards
        while owner[at[s]] >= 0:
            at[s] = (at[s] + skip[s]) % slots
        owner[at[s]] = s
    return owner


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """docs with their slot and shard."""
    spark = docs.sparkSession
    owners = spark.createDataFrame(list(enumerate(lookup(shards, slots))), "slot long, shard int")
    slot = F.conv(F.substring(F.md5(doc_key(key)), 1, 15), 16, 10).cast("long") % slots
    return without(docs, "slot", "shard").withColumn("slot", slot).join(F.broadcast(owners), "slot", "left")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


ORACLE = f"""
WITH RECURSIVE pref AS (
  SELECT s, ('0x' || substr(md5('shard-' || s || ':offset'), 1, 15))::BIGINT % {SLOTS} AS first_slot,
         ('0x' || substr(md5('shard-' || s || ':skip'), 1, 15))::BIGINT % ({SLOTS} - 1) + 1 AS skip
  FROM range({SHARDS}) r(s)
), claims AS (
  SELECT -1 AS turn, list_transform(range({SLOTS}), lambda x: -1) AS owner
  UNION ALL
  SELECT turn, list_concat(list_concat(owner[:slot], [shard]), owner[slot + 2:]) FROM (
    SELECT c.turn + 1 AS turn, c.owner, p.s AS shard, (p.first_slot + p.skip * list_filter(range({SLOTS}),
             lambda j: c.owner[(p.first_slot + j * p.skip) % {SLOTS} + 1] < 0)[1]) % {SLOTS} AS slot
    FROM claims c JOIN pref p ON p.s = (c.turn + 1) % {SHARDS} WHERE c.turn + 1 < {SLOTS})
)
SELECT doc_id, m.slot, c.owner[m.slot + 1]::INTEGER AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents) m,
     (SELECT owner FROM claims WHERE turn = {SLOTS} - 1) c
"""
