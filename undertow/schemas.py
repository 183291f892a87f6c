"""Record schemas and their validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.config import D

GEO = "struct<lat:double,lon:double,geohash:string>"
ENTITY = f"struct<text:string,type:string,geo:{GEO}>"
ITEM = (
    "id string, source string, source_class string, ts_observed timestamp, ts_event timestamp, lang string, text string, "
    f"entities array<{ENTITY}>, geo {GEO}, urls array<string>, author_ref string, parent_ref string, content_hash string, raw_ref string"
)
ENRICHED = f"item struct<{ITEM.replace(' ', ':').replace(',:', ',')}>, embedding array<float>, exploration boolean"
TALLY = "bucket_ts timestamp, counts map<string,int>, sampling_active boolean, theta double, replica string, flushed_at timestamp"
CLAIM_REQUEST = "story_id string, item_id string, text string"
CLAIM_RESULT = "story_id string, item_id string, claim string"
STORY = "id string, first_seen timestamp, last_seen timestamp, entity_set array<string>, source_set array<string>, independent_origins int, trust_state string, velocity_z double, mainstream_presence double, inauthenticity double, gap double, centroid array<float>"
ALERT = "story_id string, ts timestamp, gap double, velocity_z double, trust_state string"
EDGE = "story_id string, src_item string, dst_item string, edge_type string, ts_observed timestamp"
SYSTEM_STATE = "key string, value string, updated_at timestamp"

SOURCE_CLASSES = ("social", "authoritative", "primary", "mainstream", "local_news")
TRUST_STATES = ("rumor", "corroborated", "primary_backed")
EDGE_TYPES = ("ref", "copy", "url", "author")


def within(column: str, longest: int) -> Column:
    return F.length(column) <= longest


def valid_geo(geo: Column | str) -> Column:
    geo = F.col(geo) if isinstance(geo, str) else geo
    fits = geo["lat"].between(-90, 90) & geo["lon"].between(-180, 180) & (F.coalesce(F.length(geo["geohash"]), F.lit(0)) <= 16)
    return geo.isNull() | F.coalesce(fits, F.lit(False))


def valid_item() -> Column:
    """Whether a row obeys the caps of the item schema; never null."""
    caps = (("source", 64), ("lang", 8), ("text", D.max_text), ("author_ref", 256), ("content_hash", 256), ("raw_ref", 256))
    fits = F.col("source_class").isin(*SOURCE_CLASSES)
    for column, longest in caps:
        fits = fits & within(column, longest)
    fits = fits & (F.col("parent_ref").isNull() | within("parent_ref", 256))
    fits = fits & (F.size("entities") <= D.max_entities) & (F.size("urls") <= D.max_urls) & valid_geo("geo")
    return F.coalesce(fits & F.forall("entities", lambda e: (F.length(e["text"]) <= 256) & valid_geo(e["geo"])), F.lit(False))


def valid_tally() -> Column:
    """At most 4,096 counted keys of 1 to 256 characters, no negative count, theta within 0 and 1; never null."""
    keys = F.forall(F.map_keys("counts"), lambda k: F.length(k).between(1, 256))
    counts = F.forall(F.map_values("counts"), lambda n: n >= 0)
    return F.coalesce((F.size("counts") <= D.max_counts) & keys & counts & F.col("theta").between(0, 1), F.lit(False))


def strict_json(raw: DataFrame, column: str, ddl: str, nested: dict[str, str] | None = None) -> DataFrame:
    """raw with record (parsed column) and well_formed: it parses, and holds no field that the schema lacks.

    nested maps paths of objects inside to their schemas. Spark drops unknown fields in silence, hence the
    look at the keys themselves.
    """
    from pyspark.sql import types as T

    names = lambda d: F.array(*[F.lit(f.name) for f in T._parse_datatype_string(d).fields])
    known = F.size(F.array_except(F.json_object_keys(column), names(ddl))) == 0
    for path, inner in (nested or {}).items():
        part = F.get_json_object(column, path)
        known = known & (part.isNull() | (F.size(F.array_except(F.json_object_keys(part), names(inner))) == 0))
    return raw.withColumn("record", F.from_json(column, ddl)).withColumn("well_formed", F.coalesce(known, F.lit(False)))
