"""Raw feed records (one JSON document a row, in column raw) as items. Unusable records are dropped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from undertow.config import D
from undertow.functions.geo import mean_vertex
from undertow.functions.text import digest_key, html_text
from undertow.schemas import ENTITY, GEO

SCHEMAS = {
    "usgs": "id string, geometry struct<coordinates:array<double>>, properties struct<mag:double,place:string,time:bigint,updated:bigint,url:string,title:string>",
    "noaa": "id string, geometry struct<type:string,coordinates:array<array<array<double>>>>, properties struct<id:string,event:string,headline:string,severity:string,areaDesc:string,sent:string,effective:string,onset:string,status:string,messageType:string>",
    "gdacs": "geometry struct<type:string,coordinates:array<double>>, properties struct<eventtype:string,eventid:string,episodeid:string,name:string,description:string,alertlevel:string,country:string,fromdate:string,todate:string,datemodified:string,url:struct<report:string>>",
    "gdelt": "url string, url_mobile string, title string, seendate string, socialimage string, domain string, language string, sourcecountry string",
    "rss": "title string, link string, guid string, pubdate string, creator string, description string",
    "bluesky": "did string, time_us bigint, kind string, commit struct<rev:string,operation:string,collection:string,rkey:string,cid:string,record:struct<createdAt:string,langs:array<string>,text:string,reply:struct<parent:struct<uri:string,cid:string>>,facets:array<struct<features:array<struct<uri:string>>>>>>",
    "mastodon": "id string, created_at string, in_reply_to_id string, language string, uri string, url string, visibility string, sensitive boolean, content string, account struct<id:string,acct:string,bot:boolean>, reblog struct<id:string>",
    "wikipedia": "meta struct<uri:string,id:string,domain:string,dt:string>, id bigint, type string, namespace int, title string, comment string, user string, bot boolean, minor boolean, revision struct<old:bigint,new:bigint>, server_name string, title_url string",
}
POSTS = "app.bsky.feed.post"
NO_ENTITIES = f"array<{ENTITY}>"


def parsed(raw: DataFrame, feed: str) -> DataFrame:
    """raw with r, the record; a value of another type than the schema's becomes null."""
    return raw.withColumn("r", F.from_json("raw", SCHEMAS[feed]))


def iso_time(value: Column, naive_utc: bool = False) -> Column:
    """A timestamp from ISO 8601; one without a zone is null, or UTC if so asked."""
    zoned = value.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$")
    naive = value.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?)?$")
    out = F.when(zoned, F.try_to_timestamp(F.regexp_replace(value, r"([+-]\d\d)(\d\d)$", "$1:$2")))
    return out.when(naive, F.try_to_timestamp(F.concat(value, F.when(value.rlike("[T ]"), "Z").otherwise("T00:00:00Z")))) if naive_utc else out


@F.pandas_udf(TimestampType())
def mail_time(values: pd.Series) -> pd.Series:
    """RFC 822 dates, with two-digit years and zone names; null without a zone."""
    from datetime import UTC
    from email.utils import parsedate_to_datetime

    def one(value: str | None):
        try:
            found = parsedate_to_datetime(value)
        except (TypeError, ValueError):
            return None
        return found.astimezone(UTC) if found is not None and found.tzinfo is not None else None

    return pd.to_datetime(values.map(one, na_action="ignore"), utc=True)  # with its zone, as the session's may be another


def filled(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def point(coordinates: Column) -> Column:
    lon, lat = F.get(coordinates, F.lit(0)), F.get(coordinates, F.lit(1))
    fits = (F.size(coordinates) >= 2) & lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(fits, F.struct(lat.alias("lat"), lon.alias("lon"), F.lit(None).cast("string").alias("geohash")))


def places(names: Column, geo: Column) -> Column:
    """Place entities of names, each trimmed and cut; empty ones are left out."""
    kept = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")
    entities = F.transform(kept, lambda n: F.struct(F.substring(n, 1, 256).alias("text"), F.lit("place").alias("type"), geo.alias("geo")))
    return F.coalesce(entities, F.array().cast(NO_ENTITIES))


def link(url: Column) -> Column:
    return F.when(url.startswith("http"), F.array(F.substring(url, 1, D.max_url))).otherwise(F.array().cast("array<string>"))


def item(rows: DataFrame, source: str, source_class: str, text: Column, content_hash: Column, keep: Column | None = None, **fields: Column) -> DataFrame:
    """Items of rows whose text and content_hash are not empty and that are kept; other fields have the schema's defaults."""
    none = F.lit(None)
    columns = {
        "source": F.lit(source), "source_class": F.lit(source_class), "ts_event": none.cast("timestamp"), "lang": F.lit("und"), "text": F.substring(text, 1, D.max_text),
        "entities": F.array().cast(NO_ENTITIES), "geo": none.cast(GEO), "urls": F.array().cast("array<string>"), "author_ref": F.lit(""), "parent_ref": none.cast("string"),
        "content_hash": content_hash, "raw_ref": F.lit(""),
    } | fields
    # a cut before a filter: an unusable record has no text or key, whatever else it holds
    out = rows.where(F.coalesce(keep, F.lit(False))) if keep is not None else rows
    return out.select(*[c.alias(name) for name, c in columns.items()]).where(filled(F.col("text")) & filled(F.col("content_hash")))


def usgs(raw: DataFrame) -> DataFrame:
    p = F.col("r.properties")
    geo = point(F.col("r.geometry.coordinates"))
    text = F.when(filled(p["title"]), p["title"]).when(filled(p["place"]) & p["mag"].isNotNull(), F.concat(F.lit("M"), p["mag"].cast("string"), F.lit(" - "), p["place"])).otherwise(p["place"])
    names = F.when(filled(p["place"]), F.array(p["place"])).otherwise(F.array().cast("array<string>"))
    urls = F.when(filled(p["url"]), F.array(F.substring(p["url"], 1, D.max_url))).otherwise(F.array().cast("array<string>"))
    key = F.substring("r.id", 1, 256)
    return item(parsed(raw, "usgs"), "usgs", "authoritative", text, key, ts_event=F.timestamp_millis(p["time"]), geo=geo, entities=places(names, geo), urls=urls, raw_ref=key)


def noaa(raw: DataFrame) -> DataFrame:
    p = F.col("r.properties")
    geometry = F.col("r.geometry")
    centre = mean_vertex(F.get(geometry["coordinates"], F.lit(0)))
    geo = F.when((geometry["type"] == "Polygon") & centre.isNotNull(), F.struct(centre["lat"].alias("lat"), centre["lon"].alias("lon"), F.lit(None).cast("string").alias("geohash")))
    text = F.when(filled(p["headline"]), p["headline"]).when(filled(p["event"]) & filled(p["areaDesc"]), F.concat_ws(" - ", p["event"], p["areaDesc"])).otherwise(p["event"])
    urn = F.substring(F.when(filled(p["id"]), p["id"]).otherwise(F.col("r.id")), 1, 256)
    time = F.coalesce(*[iso_time(p[c]) for c in ("onset", "effective", "sent")])
    names = F.slice(F.split(p["areaDesc"], ";"), 1, 32)
    return item(parsed(raw, "noaa"), "noaa", "authoritative", text, urn, p["status"] == "Actual", ts_event=time, geo=geo, entities=places(names, F.lit(None).cast(GEO)), urls=link(F.col("r.id")), raw_ref=urn)


def gdacs(raw: DataFrame) -> DataFrame:
    p = F.col("r.properties")
    geo = F.when(F.col("r.geometry.type") == "Point", point(F.col("r.geometry.coordinates")))
    name = F.when(filled(p["description"]), p["description"]).otherwise(p["name"])
    text = F.when(filled(p["alertlevel"]) & filled(name), F.concat(F.lit("GDACS "), p["alertlevel"], F.lit(" alert: "), name)).otherwise(name)
    key = F.when(filled(p["eventtype"]) & filled(p["eventid"]), F.substring(F.concat_ws(":", F.lit("gdacs"), p["eventtype"], p["eventid"]), 1, 256))
    names = F.slice(F.split(p["country"], ","), 1, 16)
    return item(parsed(raw, "gdacs"), "gdacs", "authoritative", text, key, ts_event=iso_time(p["fromdate"], True), geo=geo, entities=places(names, geo), urls=link(p["url"]["report"]), raw_ref=key)


def gdelt(raw: DataFrame) -> DataFrame:
    url, domain = F.col("r.url"), F.substring(F.coalesce("r.domain", F.lit("")), 1, 256)
    lang = F.when(F.lower("r.language") == "english", "en").otherwise("und")
    time = F.try_to_timestamp("r.seendate", F.lit("yyyyMMdd'T'HHmmssX"))
    return item(parsed(raw, "gdelt"), "gdelt", "mainstream", F.col("r.title"), digest_key("gdelt:", url), url.startswith("http"), ts_event=time, lang=lang, urls=link(url), author_ref=domain, raw_ref=domain)


def rss(raw: DataFrame, source: str, source_class: str = "authoritative", max_age_days: int | None = None, now: Column | None = None) -> DataFrame:
    """Press releases. Those dated earlier than max_age_days before now go; undated ones stay."""
    ref = F.trim(F.when(filled(F.col("r.guid")), F.col("r.guid")).otherwise(F.col("r.link")))
    out = item(parsed(raw, "rss"), source, source_class, F.trim("r.title"), ref, ts_event=mail_time("r.pubdate"), urls=link(F.col("r.link")), raw_ref=ref)
    if max_age_days is None:
        return out
    wall = (now if now is not None else F.current_timestamp()) - F.make_dt_interval(days=F.lit(max_age_days))
    return out.where(F.col("ts_event").isNull() | (F.col("ts_event") >= wall))


def language_allowed(lang: Column, langs: tuple[str, ...]) -> Column:
    return F.get(F.split(F.lower(lang), "-"), F.lit(0)).isin(*langs)


def bluesky_kept(langs: tuple[str, ...] = ("en",)) -> Column:
    commit = F.col("r.commit")
    post = (F.col("r.kind") == "commit") & (commit["operation"] == "create") & (commit["collection"] == POSTS)
    return post & filled(F.trim(commit["record"]["text"])) & F.coalesce(F.exists(commit["record"]["langs"], lambda x: language_allowed(x, langs)), F.lit(False))


def bluesky(raw: DataFrame, langs: tuple[str, ...] = ("en",)) -> DataFrame:
    did, commit = F.col("r.did"), F.col("r.commit")
    record = commit["record"]
    uri = F.when(filled(commit["rkey"]), F.concat(F.lit("at://"), did, F.lit(f"/{POSTS}/"), commit["rkey"]))
    parent = record["reply"]["parent"]["uri"]
    found = F.flatten(F.transform(record["facets"], lambda f: F.coalesce(F.transform(f["features"], lambda x: x["uri"]), F.array().cast("array<string>"))))
    urls = F.transform(F.slice(F.array_distinct(F.filter(found, lambda u: u.startswith("http"))), 1, D.max_urls), lambda u: F.substring(u, 1, D.max_url))
    lang = F.coalesce(F.substring(F.lower(F.get(record["langs"], F.lit(0))), 1, 8), F.lit("und"))
    return item(
        parsed(raw, "bluesky"), "bluesky", "social", record["text"], digest_key("bsky:", uri), bluesky_kept(langs), ts_event=iso_time(record["createdAt"]), lang=lang,
        urls=F.coalesce(urls, F.array().cast("array<string>")), author_ref=digest_key("", did, 32), parent_ref=F.when(filled(parent), digest_key("bsky:", parent)), raw_ref=F.substring(F.coalesce(commit["cid"], F.lit("")), 1, 256),
    )


def mastodon_kept(langs: tuple[str, ...] = ("en",), skip_bots: bool = True) -> Column:
    kept = F.col("r.reblog").isNull() & (F.col("r.visibility") == "public") & language_allowed(F.col("r.language"), langs)
    return kept & ~F.coalesce("r.account.bot", F.lit(False)) if skip_bots else kept


def mastodon(raw: DataFrame, instance: str, langs: tuple[str, ...] = ("en",), skip_bots: bool = True) -> DataFrame:
    uri, account = F.col("r.uri"), F.col("r.account.id")
    author = F.when(filled(account), digest_key("", F.concat(F.lit(f"{instance}:"), account), 32)).otherwise("")
    lang = F.when(filled(F.col("r.language")), F.substring(F.lower("r.language"), 1, 8)).otherwise("und")
    return item(
        parsed(raw, "mastodon"), "mastodon", "social", html_text(F.col("r.content")), F.when(filled(uri), digest_key("masto:", uri)), mastodon_kept(langs, skip_bots),
        ts_event=iso_time(F.col("r.created_at")), lang=lang, urls=link(F.col("r.url")), author_ref=author, raw_ref=F.substring(F.coalesce("r.id", F.lit("")), 1, 256),
    )


def wikipedia_kept(domains: tuple[str, ...] = ("en.wikipedia.org",), skip_minor: bool = False) -> Column:
    kept = F.col("r.meta.domain").isin(*domains) & (F.col("r.namespace") == 0) & F.col("r.type").isin("edit", "new") & (F.col("r.bot") == F.lit(False))
    return kept & ~F.coalesce("r.minor", F.lit(False)) if skip_minor else kept


def wikipedia(raw: DataFrame, domains: tuple[str, ...] = ("en.wikipedia.org",), skip_minor: bool = False) -> DataFrame:
    meta, title = F.col("r.meta"), F.col("r.title")
    text = F.when(filled(title) & filled(F.col("r.comment")), F.concat(title, F.lit(" — "), F.col("r.comment"))).otherwise(title)
    ref = F.when(F.coalesce("r.revision.new", F.lit(0)) != 0, F.col("r.revision.new").cast("string")).when(filled(meta["id"]), meta["id"])
    key = F.substring(F.concat(F.lit("wiki:"), meta["domain"], F.lit(":"), ref), 1, 256)
    name = F.regexp_extract("r.server_name", r"^([^.]{2,8})\.wikipedia\.org$", 1)
    author = F.when(filled(F.col("r.user")), digest_key("", F.concat(meta["domain"], F.lit(":"), F.col("r.user")), 32)).otherwise("")
    uri = F.when(filled(meta["uri"]), meta["uri"]).otherwise(F.col("r.title_url"))
    return item(
        parsed(raw, "wikipedia"), "wikipedia", "primary", text, key, wikipedia_kept(domains, skip_minor), ts_event=iso_time(meta["dt"]),
        lang=F.when(filled(name), name).otherwise("und"), urls=link(uri), author_ref=author, raw_ref=F.substring(F.coalesce(meta["id"], F.lit("")), 1, 256),
    )


def revision_key(feed: str) -> Column:
    """What tells a poller that a record was seen as it is: it changes with a revision, unlike content_hash."""
    p, text = F.col("r.properties"), lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return {
        "usgs": lambda: F.concat(text(F.col("r.id")), F.lit(":"), text(p["updated"])),
        "noaa": lambda: F.concat(text(p["id"]), F.lit(":"), text(p["sent"])),
        "gdacs": lambda: F.concat_ws(":", *[text(p[c]) for c in ("eventtype", "eventid", "episodeid", "datemodified")]),
        "gdelt": lambda: text(F.col("r.url")),
        "rss": lambda: F.when(filled(F.col("r.guid")), F.col("r.guid")).otherwise(text(F.col("r.link"))),
    }[feed]()
