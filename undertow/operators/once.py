"""A table that takes each key once, with a Bloom filter of its keys under the same commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.operators.graph import frozen
from undertow.operators.parts import Parts

#: Of one block, which is what bitmap_construct_agg makes; and how many of them a key sets.
BITS, PROBES = 32_768, 4


def filtered(keys: DataFrame, blocks: int) -> DataFrame:
    """day, block, bits: the filter of keys (day, h), with blocks of 32,768 bits for each day."""
    bit = F.explode(F.array(*[position(i) for i in range(PROBES)]))
    placed = keys.select("day", F.pmod("h", F.lit(blocks)).alias("block"), bit.alias("bit"))
    return placed.groupBy("day", "block").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"))


def merged(filters: DataFrame) -> DataFrame:
    return filters.groupBy("day", "block").agg(F.bitmap_or_agg(F.col("bits")).alias("bits"))


def position(probe: int) -> Column:
    return F.shiftright(F.xxhash64("h", F.lit("bits")), 15 * probe).bitwiseAND(BITS - 1)


def may_hold() -> Column:
    """Whether all bits of a key h are set in bits."""
    out = F.lit(True)
    for probe in range(PROBES):
        at = position(probe)
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        power = F.get(F.array(*[F.lit(1 << i).cast("long") for i in range(8)]), at.bitwiseAND(7).cast("int"))
        out = out & (byte.bitwiseAND(power) > 0)
    return out


class OnceStore:
    """Rows of which each key (columns; none of them null) is kept once, the first that a batch brings.

    A batch's keys are held against the filter, by day and block, and only those that may be there meet the keys of the table,
    of their days; so the keys of a batch that is new are neither read nor shuffled again, and a false positive costs a look,
    never a row. Filter and rows become visible in one commit. blocks is for a day: about a key for every 12 of its
    32,768 * blocks bits; with more keys the filter lets more through, and results stay the same.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...], ts: str, blocks: int = 1024, fan: int = 8):
        self.spark, self.keys, self.ts, self.blocks = spark, keys, ts, blocks
        self.parts = Parts(spark, folder, {"filters": merged}, fan)

    def keyed(self, rows: DataFrame) -> DataFrame:
        """rows with the day of their time and a hash of their key."""
        return rows.withColumns({"once_day": F.to_date(self.ts), "once_hash": F.xxhash64(*self.keys)})

    def doubtful(self, keyed: DataFrame) -> DataFrame:
        """day and key of those keyed rows that the filter does not rule out."""
        asked = keyed.select(F.struct(*self.keys).alias("key"), F.col("once_day").alias("day"), F.col("once_hash").alias("h"), F.pmod("once_hash", F.lit(self.blocks)).alias("block"))
        return asked.join(self.parts.merged("filters"), ["day", "block"]).where(may_hold()).select("day", "key")

    def add(self, batch: int, rows: DataFrame) -> int | None:
        """Commit a batch; how many of its rows had to be looked for in the table. None if it was committed before."""
        if self.parts.batch() >= batch:
            return None
        known, looked = self.parts.read("rows"), 0
        new = frozen(self.keyed(rows.dropna(subset=[*self.keys, self.ts]).dropDuplicates(list(self.keys))))
        if known is not None:
            maybe = frozen(self.doubtful(new))
            looked, first, last = maybe.agg(F.count("*"), F.min("day"), F.max("day")).first()
            if looked:
                there = known.where(F.to_date(self.ts).between(F.lit(first), F.lit(last))).select(*self.keys)
                new = frozen(new.join(maybe.select("key.*").join(there, list(self.keys), "left_semi"), list(self.keys), "left_anti"))
        keys = new.select(F.col("once_day").alias("day"), F.col("once_hash").alias("h"))
        kept = new.select(*rows.columns).repartitionByRange(F.col(self.ts)).sortWithinPartitions(self.ts)  # so that days are apart in files
        self.parts.add(batch, {"rows": kept, "filters": filtered(keys, self.blocks)})
        return looked

    def rows(self) -> DataFrame | None:
        return self.parts.read("rows")
