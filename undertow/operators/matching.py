"""Primary match as one pass over both sides in order: each claim takes the newest official items that share an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.config import D
from undertow.functions.geo import haversine_km
from undertow.operators.graph import frozen

#: Rows that a pass takes at once: with 50 items each, some 10 MB.
STEP = 4096


def names(entities: Column) -> Column:
    """What rows are met by: lower-cased entities, each once, the empty one and null left out."""
    return F.array_distinct(F.filter(F.transform(entities, F.lower), lambda e: e != ""))


def newest_before(rows: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """Of rows in order: those that ask, each with near, the last most rows of the same keys before it that do not ask.

    rows (keys, asks boolean, seen struct, and others). A partition is read once, in its order, with most rows in memory
    beside those at hand; keys must not be spread over partitions.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    kept = [c for c in rows.columns if c not in ("asks", "seen")]
    schema = T.StructType([*(T.StructField(c, kinds[c]) for c in kept), T.StructField("near", T.ArrayType(kinds["seen"]))])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held = to_arrow_schema(schema), None
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                part = part if held is None else pa.concat_batches([held, part])
                asks = part["asks"].to_numpy(zero_copy_only=False)
                begins = np.zeros(part.num_rows, bool)
                begins[0] = True
                for key in keys:
                    code = part[key].dictionary_encode().indices.to_numpy(zero_copy_only=False)
                    begins[1:] |= code[1:] != code[:-1]
                until = np.cumsum(~asks)  # rows seen up to here
                own = np.maximum.accumulate(np.where(begins, until - ~asks, 0))  # and those of other keys
                since = np.maximum(until - most, own)
                seen, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
                held = part.take(pa.array(seen[since[-1] : until[-1]]))
                if not len(asking):
                    continue
                first, n = since[asking], (until - since)[asking]
                ends = np.cumsum(n)
                taken = np.arange(ends[-1]) - np.repeat(ends - n - first, n)
                near = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), part["seen"].take(pa.array(seen[taken])))
                out = part.take(pa.array(asking))
                yield pa.RecordBatch.from_arrays([*(out[c].cast(arrow.field(c).type) for c in kept), near.cast(arrow.field("near").type)], schema=arrow)

    return rows.mapInArrow(run, schema)


def newest_shared(claims: DataFrame, official: DataFrame, seconds: int = D.match_s, most: int = D.match_candidates) -> DataFrame:
    """story_id, claim, entity, t, la, lo, near: for each claim and entity of it the most newest official items (array of
    ts, id, lat, lon; oldest first) that share the entity, at most seconds later; older than that before are among them.

    Both sides are dealt out by ranges of entity and time, so that an entity that holds a third of all rows is spread over
    many tasks. A range starts with the newest items of its first entity in the ranges before it, which are found in the
    same way among the last most items of each range: at most that many rows a range, whatever the size of the input.
    """
    n = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = claims.where("ts IS NOT NULL").select(F.explode(names(F.col("entities"))).alias("entity"), (F.col("ts") + seconds).alias("at"), F.lit(True).alias("asks"), "story_id", F.col("id").alias("claim"), F.col("ts").alias("t"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    b = official.where("ts IS NOT NULL").select(F.explode(names(F.col("entities"))).alias("entity"), F.col("ts").alias("at"), F.lit(False).alias("asks"), F.struct("ts", "id", "lat", "lon").alias("seen"))
    rows = a.unionByName(b, allowMissingColumns=True).distinct()
    order = ("entity", "at", "asks", F.desc("seen.id"), "claim")  # what is newer comes later; of one time the smaller id
    ranged = frozen(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.min("entity").alias("first"), F.max("entity").alias("last"))  # a row a range
    shared = ends.select("part", F.col("last").alias("entity")).join(ends.select(F.col("first").alias("entity")).distinct(), "entity")
    place = F.row_number().over(W.partitionBy("part").orderBy(F.desc("at"), "seen.id"))
    tails = ranged.where("NOT asks").join(shared, ["part", "entity"]).withColumn("place", place).where(F.col("place") <= most)
    asked = ends.select("part", F.col("first").alias("entity"), F.lit(True).alias("asks"))
    both = tails.select("part", "entity", "asks", "at", "seen").unionByName(asked, allowMissingColumns=True)
    carried = newest_before(both.repartition(n, "entity").sortWithinPartitions("entity", "part", F.desc("asks"), "at", F.desc("seen.id")).drop("at"), ("entity",), most)
    carried = carried.select("part", "entity", F.explode("near").alias("seen")).withColumns({"asks": F.lit(False), "at": F.col("seen.ts")})
    whole = ranged.unionByName(carried, allowMissingColumns=True).repartition(n, "part").sortWithinPartitions("part", *order).drop("at")
    return newest_before(whole, ("part", "entity"), most).drop("part")


def primary_matches(claims: DataFrame, official: DataFrame) -> DataFrame:
    """story_id, id, primary_id: the newest official item that backs a claim.

    claims (story_id, id, ts, entities, lat, lon); official (id, ts, entities, lat, lon). Some entity in
    common, within a day, and not farther apart than 500 km where both have a place. Only the newest 50
    with a common entity in time are looked at, before distance is. Each entity of a claim brings its newest 50, and these
    are merged, so no row is made for a match that is cut. Rows without a time, or without an entity, match nothing;
    repeated rows count once.
    """
    met = newest_shared(claims, official)
    fits = lambda s: F.coalesce(haversine_km(F.col("la"), F.col("lo"), s["lat"], s["lon"]) <= D.match_km, F.lit(True))
    in_time = F.filter("near", lambda s: s["ts"] >= F.col("t") - D.match_s)
    met = met.select("story_id", "claim", F.transform(in_time, lambda s: F.struct((-s["ts"]).alias("age"), s["id"].alias("id"), fits(s).alias("fits"))).alias("near")).where(F.size("near") > 0)
    merged = met.groupBy("story_id", "claim").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))  # 50 an entity
    backing = F.filter(F.slice("near", 1, D.match_candidates), lambda s: s["fits"])
    return merged.where(F.size(backing) > 0).select("story_id", F.col("claim").alias("id"), F.get(backing, F.lit(0))["id"].alias("primary_id"))
