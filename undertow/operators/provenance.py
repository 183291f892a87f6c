"""Who depends on whom within a story, and what its independent origins are worth."""

from __future__ import annotations

import itertools
from array import array

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.config import D
from undertow.functions.text import hamming
from undertow.operators.graph import components, frozen
from undertow.operators.matching import primary_matches

RANK = {"rumor": 0, "corroborated": 1, "primary_backed": 2}


def origin_key() -> Column:
    """Wire service, for outlets that carry wire copy; else author; else feed, for all but social items; else ''."""
    outlet = F.col("source_class").isin("local_news", "mainstream")
    return (
        F.when((F.col("wire_ref") != "") & outlet, F.concat(F.lit("wire:"), F.col("wire_ref")))
        .when(F.col("author_ref") != "", F.col("author_ref"))
        .when((F.col("source_class") != "") & (F.col("source_class") != "social"), F.concat(F.lit("src:"), F.col("source")))
        .otherwise("")
    )


def nodes(items: DataFrame) -> DataFrame:
    """items with what edges look at: canonical URLs without empty ones, simhash (0 for no text) and wire_ref."""
    from undertow.functions.text import simhash_blake2b, wire_ref
    from undertow.functions.url import canonical_url

    urls = F.array_distinct(F.filter(F.transform("urls", lambda u: canonical_url(u)), lambda u: u != ""))
    return items.withColumns({"urls": urls, "simhash": F.coalesce(simhash_blake2b("text"), F.lit(0)), "wire_ref": wire_ref(F.col("text"))})


def _toward(pairs: DataFrame, kind: str) -> DataFrame:
    """Edges lead from the later item to the earlier one."""
    later = F.struct("x_ts", "x_id") > F.struct("y_ts", "y_id")
    return pairs.select("story_id", F.when(later, F.col("x_id")).otherwise(F.col("y_id")).alias("src"), F.when(later, F.col("y_id")).otherwise(F.col("x_id")).alias("dst"), F.greatest("x_ts", "y_ts").alias("ts"), F.lit(kind).alias("edge_type"))


def _oriented(pairs: DataFrame, kind: str) -> DataFrame:
    """One edge for each pair, however often it is there."""
    return _toward(pairs.where(F.col("x_id") != F.col("y_id")), kind).distinct()


def _side(items: DataFrame, prefix: str, key: Column) -> DataFrame:
    return items.select("story_id", key.alias("key"), F.col("id").alias(f"{prefix}_id"), F.col("ts").alias(f"{prefix}_ts"))


def ref_edges(items: DataFrame) -> DataFrame:
    """One refers to the other: its parent_ref is the other's content_hash."""
    x = _side(items, "x", F.col("parent_ref")).where("key <> ''")
    return _oriented(x.join(_side(items, "y", F.col("content_hash")), ["story_id", "key"]), "ref")


def edge_members(items: DataFrame, kind: str) -> DataFrame:
    """story_id, key, id, ts, before: who shares an author or a URL (kind), a row an item and key, in the place of all pairs.
    before has those of the item's keys that sort before this one."""
    if kind == "author":
        rows = items.select("story_id", F.col("author_ref").alias("key"), "id", "ts", F.array().cast("array<string>").alias("before"))
    else:
        keys = items.select("story_id", "id", "ts", F.filter(F.array_distinct("urls"), lambda u: u != "").alias("keys"))
        rows = keys.withColumn("key", F.explode("keys")).select("story_id", "key", "id", "ts", F.array_sort(F.filter("keys", lambda u: u < F.col("key"))).alias("before"))
    return rows.where("key <> ''")


def member_edges(members: DataFrame, kind: str, tile: int = 2048) -> DataFrame:
    """Edges between all members (story_id, key, id, ts, before) of a key, each pair once: in the first key that it shares.

    No pair is shuffled or held. A key's members are dealt into tiles of about tile rows, and each two tiles meet in a place
    of their own, so the pairs of a crowded key are made by many tasks, and a member travels once for each tile of its key.
    """
    spot = ["story_id", "key", "x_tile", "y_tile"]
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.select("story_id", "key", "id", "ts", "before").distinct()
    tiles = rows.groupBy("story_id", "key").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = rows.join(tiles, ["story_id", "key"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    named = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("id", "ts", "before")]
    x = dealt.select("story_id", "key", F.col("tile").alias("x_tile"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("y_tile"), *named("x"))
    y = dealt.select("story_id", "key", F.explode(F.sequence(F.lit(0), "tile")).alias("x_tile"), F.col("tile").alias("y_tile"), *named("y"))
    # dealt out by number, as adaptive execution would join the few bytes of members into few tasks, which make all pairs
    met = x.repartition(n, *spot).join(y.repartition(n, *spot), spot).where((F.col("x_tile") < F.col("y_tile")) | (F.col("x_id") < F.col("y_id")))
    return _toward(met if kind == "author" else met.where(~F.arrays_overlap("x_before", "y_before")), kind)


def author_edges(items: DataFrame) -> DataFrame:
    return member_edges(edge_members(items, "author"), "author")


def url_edges(items: DataFrame) -> DataFrame:
    """Canonical URLs in common; empty ones do not count."""
    return member_edges(edge_members(items, "url"), "url")


def copy_edges(items: DataFrame, bits: int = D.copy_bits) -> DataFrame:
    """Simhashes within bits, both not 0. Of bits + 1 bands of the 64, one is equal in such a pair: those are joined."""
    bands = bits + 1
    cuts = [64 * i // bands for i in range(bands + 1)]
    band = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("simhash", a).bitwiseAND((1 << b - a) - 1).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
    hashed = frozen(items.select("story_id", "id", "ts", "simhash"))  # narrow; both sides read it, and hashes may be costly
    side = hashed.where(F.coalesce("simhash", F.lit(0)) != 0).select("story_id", F.explode(band).alias("key"), "id", "ts", "simhash")
    x, y = (side.select("story_id", "key", F.col("id").alias(f"{p}_id"), F.col("ts").alias(f"{p}_ts"), F.col("simhash").alias(f"{p}_hash")) for p in "xy")
    return _oriented(x.join(y, ["story_id", "key"]).where((F.col("x_id") < F.col("y_id")) & (hamming(F.col("x_hash"), F.col("y_hash")) <= bits)), "copy")


def _signatures(bits: int, equal: int) -> Column:
    """Parts of simhash under which two that differ by at most bits meet: of bits + equal parts of the 64 bits equal ones are the same."""
    n = bits + equal
    parts = [sum(1 << b for b in range(64 * i // n, 64 * (i + 1) // n)) for i in range(n)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(sum(some)) for some in itertools.combinations(parts, equal)]
    return F.array(*[F.struct(F.lit(i).alias("parts"), F.col("simhash").bitwiseAND(F.lit(mask).cast("long")).alias("equal")) for i, mask in enumerate(masks)])


def _equal_parts(rows: int, bits: int) -> int:
    """The fewest equal parts whose bits tell about as many values apart as there are rows, so that few meet by chance."""
    return next(e for e in range(1, 7) if e == 6 or 2 ** (64 * e // (bits + e)) >= rows / 4)


def copy_classes(hashed: DataFrame, bits: int = D.copy_bits) -> tuple[DataFrame, DataFrame]:
    """((id, first), (src, dst)) for copies among all rows (id, simhash), however many stories they are in.

    first is the least id of those with the same simhash; src and dst are two such first ids, the later one first, whose
    simhashes lie within bits. So copies of one simhash are a class and no pairs, and a link between two classes is one
    row. Simhashes of 0 are left out. Of the 64 bits, cut into a few parts more than bits, some parts are equal in such a
    pair at least: rows meet under all choices of so many parts. Their number follows the number of simhashes, from 84 keys
    of 21 bits at 6 bits to 924 of 32 for billions, so that a key's rows do not grow with the table.
    """
    every = frozen(hashed.select("id", "simhash"))  # before the filter, which would have hashes made once more for itself
    rows = every.where(F.coalesce("simhash", F.lit(0)) != 0)
    distinct = frozen(rows.groupBy("simhash").agg(F.min("id").alias("first")))
    n = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sig = _signatures(bits, max(3, _equal_parts(distinct.count(), bits)))  # shorter keys meet too often, as texts of one language are alike
    side = distinct.repartition(n, F.xxhash64("simhash")).select("simhash", "first", F.explode(sig).alias("sig"))  # dealt out anew, as each row becomes many; by another hash than before, or Spark would take it for done
    x, y = (side.select("sig", F.col("simhash").alias(f"{p}_hash"), F.col("first").alias(f"{p}_id")) for p in "xy")
    links = x.join(y, "sig").where((F.col("x_id") > F.col("y_id")) & (hamming(F.col("x_hash"), F.col("y_hash")) <= bits))
    return rows.join(distinct, "simhash").select("id", "first"), links.select(F.col("x_id").alias("src"), F.col("y_id").alias("dst")).distinct()


def story_copies(items: DataFrame, bits: int = D.copy_bits) -> tuple[DataFrame, DataFrame]:
    """((story_id, simhash, first, n), (story_id, src, dst, n)) for copies within stories of items (story_id, id, ts, simhash).

    The first are classes of equal simhash, not 0: the item that came first and how many there are. The second are links
    between the first items of two classes whose simhashes lie within bits, the later one first, with the number of pairs
    that the link stands for. So m copies of one text are one row, and not m (m - 1) / 2.
    """
    known = items.where(F.coalesce("simhash", F.lit(0)) != 0)
    classes = frozen(known.groupBy("story_id", "simhash").agg(F.min(F.struct("ts", "id")).alias("first"), F.count("*").alias("n")))
    largest = classes.groupBy("story_id").count().agg(F.max("count")).first()[0] or 0
    # narrow rows meet, as each class becomes many; who came first and how many are looked up for the pairs that are found
    side = classes.select("story_id", "simhash", F.explode(_signatures(bits, _equal_parts(largest, bits))).alias("sig")).select("story_id", F.col("sig.parts").alias("parts"), F.col("sig.equal").alias("equal"), "simhash")
    x, y = (side.withColumnRenamed("simhash", f"{p}_hash") for p in "xy")
    near = (F.col("x_hash") < F.col("y_hash")) & (hamming(F.col("x_hash"), F.col("y_hash")) <= bits)
    met = x.join(y, ["story_id", "parts", "equal"]).where(near).select("story_id", "x_hash", "y_hash").distinct()
    own = lambda p: classes.select("story_id", F.col("simhash").alias(f"{p}_hash"), F.col("first").alias(f"{p}_first"), F.col("n").alias(f"{p}_n"))
    both = met.join(own("x"), ["story_id", "x_hash"]).join(own("y"), ["story_id", "y_hash"])
    later, earlier = (f("x_first", "y_first")["id"] for f in (F.greatest, F.least))
    links = both.where("x_first <> y_first").select("story_id", later.alias("src"), earlier.alias("dst"), (F.col("x_n") * F.col("y_n")).alias("n")).distinct()
    return classes.select("story_id", "simhash", F.col("first.id").alias("first"), "n"), links


def ref_links(items: DataFrame) -> DataFrame:
    """story_id, src, dst: links that connect, at every moment, what ref_edges connects, at most two for each item.

    Of the items that refer to a content_hash and of those that have it the first ones stand for all: a referring item is
    linked to the first that is referred to, and such a one to the first that refers.
    """
    place = F.struct("ts", "id")
    x, y = (items.where(f"{c} <> ''").groupBy("story_id", F.col(c).alias("key")).agg(F.min(place)["id"].alias(name)) for c, name in (("parent_ref", "x0"), ("content_hash", "y0")))
    both = x.join(y, ["story_id", "key"])
    sides = [items.select("story_id", F.col(c).alias("key"), "id").join(both, ["story_id", "key"]).select("story_id", F.col("id").alias("src"), F.col(other).alias("dst")) for c, other in (("parent_ref", "y0"), ("content_hash", "x0"))]
    return sides[0].union(sides[1]).where("src <> dst").distinct()


def all_edges(items: DataFrame) -> DataFrame:
    return ref_edges(items).union(copy_edges(items)).union(url_edges(items)).union(author_edges(items))


def shared_keys(copies: bool = False) -> Column:
    """What an item shares with others of its story, as keys: its author and its URLs, and with copies its simhash if it is
    not 0. Items of one key are linked as by author_edges, url_edges and copy_edges, without a pair between them; links of
    simhashes that are not equal are story_copies'."""
    author = F.when(F.col("author_ref") != "", F.array(F.concat(F.lit("author:"), "author_ref"))).otherwise(F.array().cast("array<string>"))
    urls = F.transform(F.filter("urls", lambda u: u != ""), lambda u: F.concat(F.lit("url:"), u))
    found = F.concat(author, F.coalesce(urls, F.array().cast("array<string>")))
    if not copies:
        return found
    text = F.when(F.coalesce("simhash", F.lit(0)) != 0, F.array(F.concat(F.lit("text:"), F.col("simhash").cast("string"))))
    return F.concat(found, F.coalesce(text, F.array().cast("array<string>")))


def key_classes(items: DataFrame) -> DataFrame:
    """story_id, key, id, first, n_links: of each key that items share the item that came first, and to how many others
    each is linked. A row an item and key, however many share it."""
    rows = items.select("story_id", "id", "ts", F.explode(F.array_distinct(shared_keys())).alias("key"))
    groups = rows.groupBy("story_id", "key").agg(F.min(F.struct("ts", "id")).alias("first"), (F.count("*") - 1).alias("n_links"))
    return rows.join(groups, ["story_id", "key"]).select("story_id", "key", "id", F.col("first.id").alias("first"), "n_links")


def origins(items: DataFrame, edges: DataFrame, keys: Column | None = None, most: int = 50_000) -> DataFrame:
    """story_id, id, source, origin: which independent origin each item belongs to.

    Items meet by edges, by their organisation and by keys (an array of strings), so that two of one organisation or key
    meet without a pair between them. Edges to items that are not there are left out. An origin is named by the least id
    of its items, as a string, however large its story. A story of up to most items is one group in memory; those of more
    are joined into components, which no task holds.
    """
    wide = items.withColumn("linked_by", F.concat(F.when(origin_key() != "", F.array(F.concat(F.lit("org:"), origin_key()))).otherwise(F.array().cast("array<string>")), keys if keys is not None else F.array().cast("array<string>")))
    wide = wide.select("story_id", "id", "source", "linked_by")
    crowded = frozen(items.groupBy("story_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("story_id"))
    if crowded.isEmpty():
        return _origins_of_small(wide, edges)
    part = lambda rows, how: rows.join(crowded, "story_id", how)
    return _origins_of_small(part(wide, "left_anti"), part(edges, "left_anti")).union(_origins_of_large(part(wide, "left_semi"), part(edges, "left_semi")))


def _origins_of_small(items: DataFrame, edges: DataFrame) -> DataFrame:
    targets = edges.groupBy("story_id", F.col("src").alias("id")).agg(F.collect_set("dst").alias("targets"))
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}

    def run(group):
        parent = {i: i for i in group["id"]}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        owner: dict = {}
        for i, keys, dsts in zip(group["id"], group["linked_by"], group["targets"], strict=True):
            for other in [*(d for d in (dsts if dsts is not None else ()) if d in parent), *(owner.setdefault(k, i) for k in keys)]:
                parent[find(other)] = find(i)
        least: dict = {}
        for i in group["id"]:
            least[find(i)] = min(least.get(find(i), i), i)
        return group[["story_id", "id", "source"]].assign(origin=[str(least[find(i)]) for i in group["id"]])

    return items.join(targets, ["story_id", "id"], "left").groupBy("story_id").applyInPandas(run, f"story_id {kinds['story_id']}, id {kinds['id']}, source string, origin string")


def _origins_of_large(items: DataFrame, edges: DataFrame) -> DataFrame:
    known = items.select("story_id", "id")
    node = lambda kind, value: F.concat_ws("|", F.col("story_id").cast("string"), F.lit(kind), F.col(value).cast("string"))
    there = edges.join(known.withColumnRenamed("id", "src"), ["story_id", "src"], "left_semi").join(known.withColumnRenamed("id", "dst"), ["story_id", "dst"], "left_semi")
    linked = there.select(node("item", "src").alias("a"), node("item", "dst").alias("b"))
    keyed = items.select("story_id", "id", F.explode("linked_by").alias("key")).select(node("item", "id").alias("a"), node("key", "key").alias("b"))
    roots = components(linked.union(keyed))
    found = frozen(items.withColumn("node", node("item", "id")).join(roots, "node", "left").select("story_id", "id", "source", F.coalesce("root", "node").alias("root")))
    named = found.groupBy("root").agg(F.min("id").cast("string").alias("origin"))
    return found.join(named, "root").select("story_id", "id", "source", "origin")


def corroboration(origin_rows: DataFrame) -> DataFrame:
    """story_id, independent_origins, distinct_sources: each origin counts once, under the first of its sources by name."""
    by_origin = origin_rows.groupBy("story_id", "origin").agg(F.min(F.when(F.col("source") != "", F.col("source"))).alias("source"))
    return by_origin.groupBy("story_id").agg(F.count("*").alias("independent_origins"), F.count_distinct("source").alias("distinct_sources"))


def rank(state: Column) -> Column:
    return F.coalesce(*[F.when(state == name, n) for name, n in RANK.items()], F.lit(0))


def next_state(current: Column, n_origins: Column, n_sources: Column, primary: Column) -> Column:
    """What the evidence implies, never less than current."""
    implied = F.when(primary, 2).when((n_origins >= D.origins) & (n_sources >= D.sources), 1).otherwise(0)
    return F.element_at(F.array(*[F.lit(s) for s in RANK]), F.greatest(implied, rank(current)) + 1)


def primary_in_story(items: DataFrame) -> DataFrame:
    """story_id, primary_matched: social and official items stand together."""
    official = F.bool_or(F.col("source_class").isin("authoritative", "primary"))
    return items.groupBy("story_id").agg((F.bool_or(F.col("source_class") == "social") & official).alias("primary_matched"))


def trust_states(items: DataFrame, edges: DataFrame, current: DataFrame | None = None, keys: Column | None = None) -> DataFrame:
    """State of each story as its final graph has it: story_id, independent_origins, distinct_sources, trust_state."""
    found = corroboration(origins(items, edges, keys)).join(primary_in_story(items), "story_id")
    found = found.join(current.select("story_id", "trust_state"), "story_id", "left") if current is not None else found.withColumn("trust_state", F.lit("rumor"))
    state = next_state(F.coalesce("trust_state", F.lit("rumor")), F.col("independent_origins"), F.col("distinct_sources"), F.col("primary_matched"))
    return found.select("story_id", "independent_origins", "distinct_sources", state.alias("trust_state"))


def arrivals(items: DataFrame, links: DataFrame, keys: Column | None = None) -> DataFrame:
    """items numbered within their story (seq, from 0, by ts and id), each with the numbers of earlier items that it meets.

    Of the items of one organisation or key each meets the first, of links (story_id, src, dst) the later end meets the
    earlier. At every moment that connects what all pairs would, with a row an item and key.
    """
    own = F.when(origin_key() != "", F.array(F.concat(F.lit("org:"), origin_key()))).otherwise(F.array().cast("array<string>"))
    order = F.row_number().over(W.partitionBy("story_id").orderBy("ts", "id")) - 1
    rows = frozen(items.select("story_id", "id", order.alias("seq"), "source", "source_class", (F.concat(own, keys) if keys is not None else own).alias("keys")))
    keyed = rows.select("story_id", "seq", F.explode(F.array_distinct("keys")).alias("key"))
    first = keyed.groupBy("story_id", "key").agg(F.min("seq").alias("first"))
    met = keyed.join(first, ["story_id", "key"]).where("seq > first").select("story_id", "seq", "first")
    number = lambda end: rows.select("story_id", F.col("id").alias(end), F.col("seq").alias(f"{end}_seq"))
    ends = links.select("story_id", "src", "dst").join(number("src"), ["story_id", "src"]).join(number("dst"), ["story_id", "dst"])
    linked = ends.where("src_seq <> dst_seq").select("story_id", F.greatest("src_seq", "dst_seq").alias("seq"), F.least("src_seq", "dst_seq").alias("first"))
    targets = met.union(linked).groupBy("story_id", "seq").agg(F.collect_set("first").alias("earlier"))
    return rows.drop("keys").join(targets, ["story_id", "seq"], "left")


def replay(items: DataFrame, links: DataFrame, keys: Column | None = None) -> DataFrame:
    """story_id, id, seq, independent_origins, distinct_sources, trust_state after each item, in order of arrival.

    The state never falls, so it depends on every prefix: later items may merge origins that counted apart.
    The first item of a story is not judged. links (story_id, src, dst) and keys as for origins. Items pass in order, one by
    one, each with the earlier ones that it meets (arrivals); of those before it only their forest is in memory, four bytes
    an item, and the source of each origin. No story is a group in memory, and no pair of items is made.
    """
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = T._parse_datatype_string(f"story_id {kinds['story_id']}, id {kinds['id']}, seq int, independent_origins int, distinct_sources int, trust_state string")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, names, story = to_arrow_schema(schema), list(RANK), Prefix()
        at = object()
        for batch in batches:
            out = []
            for story_id, i, seq, source, source_class, earlier in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if story_id != at:
                    at, story = story_id, Prefix()
                story.add(source or "", source_class, earlier or ())
                out.append((story_id, i, seq, story.origins, story.n_sources, names[story.state]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = arrivals(items, links, keys).select("story_id", "id", "seq", "source", "source_class", "earlier")
    return rows.repartition(n, "story_id").sortWithinPartitions("story_id", "seq").mapInArrow(run, schema)


class Prefix:
    """A story's origins as far as it has come: a forest of item numbers, and of each tree the first of its sources by name."""

    def __init__(self):
        self.parent, self.source, self.counts = array("i"), {}, {}
        self.origins = self.n_sources = self.state = 0
        self.social = self.official = False

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def count(self, source: str, n: int) -> None:
        if source:
            now = self.counts.get(source, 0) + n
            self.n_sources += (now > 0) - (now - n > 0)
            if now:
                self.counts[source] = now
            else:
                del self.counts[source]

    def add(self, source: str, source_class: str, earlier) -> None:
        own = len(self.parent)
        trees = {self.find(x) for x in earlier}
        named = [s for s in (source, *(self.source.pop(x) for x in trees if x in self.source)) if s]
        for s in named[bool(source):]:
            self.count(s, -1)
        self.parent.append(own)
        for x in trees:
            self.parent[x] = own
        if named:
            self.source[own] = min(named)
            self.count(min(named), 1)
        self.origins += 1 - len(trees)
        self.social |= source_class == "social"
        self.official |= source_class in ("authoritative", "primary")
        if own:
            self.state = max(self.state, 2 if self.social and self.official else int(self.origins >= D.origins and self.n_sources >= D.sources))


def candidates(replayed: DataFrame, least: int = D.candidate_origins) -> DataFrame:
    """Items whose arrival leaves a story with enough origins: their claims are extracted. Never a story's first."""
    return replayed.where((F.col("seq") > 0) & (F.col("independent_origins") >= least))


def eligible_claims(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Claims (story_id, item_id, claim) that may be backed, with their item's ts, entities and place.

    The claim says something, its item is still there and in the same story, is social, and names an entity.
    """
    known = items.select(F.col("id").alias("item_id"), F.col("story_id").alias("now_in"), "source_class", "ts", "entities", "lat", "lon")
    said = claims.where(F.trim("claim") != "").select("story_id", "item_id").distinct()
    fits = (F.col("now_in") == F.col("story_id")) & (F.col("source_class") == "social") & F.exists("entities", lambda e: F.trim(e) != "")
    return said.join(known, "item_id").where(fits).select("story_id", F.col("item_id").alias("id"), "ts", "entities", "lat", "lon")


def claim_matches(claims: DataFrame, items: DataFrame) -> DataFrame:
    """story_id, id, primary_id: the official item that backs each eligible claim; promoted() takes these."""
    return primary_matches(eligible_claims(claims, items), items.where(F.col("source_class").isin("authoritative", "primary")))


def promoted(stories: DataFrame, matches: DataFrame) -> DataFrame:
    """stories with primary_backed where some claim was matched."""
    hit = matches.select("story_id").distinct().withColumn("hit", F.lit(True))
    return stories.join(hit, "story_id", "left").withColumn("trust_state", F.when(F.col("hit"), "primary_backed").otherwise(F.col("trust_state"))).drop("hit")
