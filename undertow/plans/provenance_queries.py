"""Edges, origins, trust, neighbours and story formation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.operators import provenance, stories as story_ops
from undertow.plans.adapters import COPIED_EDGES, COPIED_ITEMS, EDGES, ITEMS, START, copied_items, items, links, table
from undertow.plans.catalog import query

WIRED = f"""{COPIED_ITEMS}, keyed AS (SELECT *, CASE WHEN source_class IN ('local_news', 'mainstream') AND id % 11 = 0 THEN 'wire:ap' WHEN author_ref <> '' THEN author_ref
WHEN source_class <> '' AND source_class <> 'social' THEN 'src:' || source ELSE '' END AS okey FROM items)"""


#: Items of stories of three kinds: as they are; without official ones; and all social, of one source.
MIXED_ITEMS = COPIED_ITEMS.replace(", items AS (", ", plain_items AS (", 1) + """, items AS (SELECT * REPLACE (CASE story_id % 3 WHEN 0 THEN source_class WHEN 1 THEN CASE WHEN id % 2 = 0 THEN 'social' ELSE 'mainstream' END ELSE 'social' END AS source_class,
  CASE story_id % 3 WHEN 2 THEN 'one' ELSE source END AS source) FROM plain_items)"""


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("story_id") % 3, F.col("id")
    classes = F.when(kind == 0, F.col("source_class")).when((kind == 1) & (n % 2 == 1), "mainstream").otherwise("social")
    return wired(spark, sf_dir).withColumns({"source_class": classes, "source": F.when(kind == 2, "one").otherwise(F.col("source"))})


def wired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with copies, of which every eleventh credits a wire service."""
    return copied_items(spark, sf_dir).withColumn("wire_ref", F.when(F.col("id") % 11 == 0, "ap").otherwise(""))


@query(f"WITH {WIRED} SELECT id, okey AS origin_key FROM keyed")
def origin_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wired(spark, sf_dir).select("id", provenance.origin_key().alias("origin_key"))


@query(f"WITH {ITEMS}, {EDGES} SELECT story_id, src, dst FROM edges WHERE edge_type = 'ref'")
def ref_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.ref_edges(items(spark, sf_dir)).select("story_id", "src", "dst")


@query(f"WITH {ITEMS}, {EDGES} SELECT story_id, src, dst FROM edges WHERE edge_type = 'author'")
def author_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.author_edges(items(spark, sf_dir)).select("story_id", "src", "dst")


@query(f"WITH {ITEMS}, {EDGES} SELECT story_id, src, dst FROM edges WHERE edge_type = 'url'")
def url_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.url_edges(items(spark, sf_dir)).select("story_id", "src", "dst")


@query(f"WITH {COPIED_ITEMS}, {COPIED_EDGES} SELECT story_id, count(*) AS copy_edges FROM edges WHERE edge_type IN ('copy', 'author') GROUP BY story_id")
def copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted from classes of authors and of copies, without an edge between two of their items."""
    from undertow.operators import scoring

    return scoring.copies_by_class(copied_items(spark, sf_dir))


@query(f"""WITH {ITEMS}, k AS (SELECT story_id, id, 'author:' || author_ref AS key FROM items WHERE author_ref <> '' UNION ALL SELECT story_id, id, 'url:' || unnest(urls) FROM items)
SELECT story_id, key, id, min(id) OVER w AS first, count(*) OVER w - 1 AS n_links FROM k WINDOW w AS (PARTITION BY story_id, key)""")
def key_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who shares an author or URL: members of classes, in the place of all pairs."""
    return provenance.key_classes(items(spark, sf_dir))


@query("""SELECT c.conv_id AS story_id, c.turn AS src, p.turn AS dst FROM conversations c JOIN conversations p ON c.conv_id = p.conv_id AND p.turn = c.turn - 1""")
def reply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation refers to the turn before."""
    turn = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("story_id"), turn.alias("id"), turn.alias("ts"), F.concat(F.lit("t"), turn.cast("string")).alias("content_hash"), F.when(turn > 0, F.concat(F.lit("t"), (turn - 1).cast("string"))).otherwise("").alias("parent_ref"))
    return provenance.ref_edges(rows).select("story_id", "src", "dst")


#: Vertices are items and keys. Labels fall by one hop a round, from the keys' own members; rounds end when nothing changes.
ORIGINS = f"""{WIRED}, {COPIED_EDGES}, hops AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges UNION
  SELECT x.id, y.id FROM keyed x JOIN keyed y ON x.story_id = y.story_id AND x.okey = y.okey WHERE x.okey <> '' AND x.id <> y.id),
reach AS (SELECT id AS a, id AS b FROM items UNION SELECT reach.a, hops.b FROM reach JOIN hops ON reach.b = hops.a),
origin AS (SELECT a AS id, min(b) AS origin FROM reach GROUP BY a)"""


def _origins(rows: DataFrame) -> DataFrame:
    return provenance.origins(rows, links(rows), provenance.shared_keys(copies=True))


@query(f"WITH RECURSIVE {ORIGINS} SELECT story_id, count(DISTINCT origin) AS independent_origins FROM items JOIN origin USING (id) GROUP BY story_id")
def independent_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = provenance.corroboration(_origins(wired(spark, sf_dir)))
    return found.select("story_id", "independent_origins")


@query(f"WITH RECURSIVE {ORIGINS}, s AS (SELECT story_id, origin, min(source) AS source FROM items JOIN origin USING (id) GROUP BY ALL) SELECT story_id, count(DISTINCT source) AS distinct_sources FROM s GROUP BY story_id")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = provenance.corroboration(_origins(wired(spark, sf_dir)))
    return found.select("story_id", "distinct_sources")


@query(f"""WITH RECURSIVE {ORIGINS.replace(COPIED_ITEMS, MIXED_ITEMS)}, s AS (SELECT story_id, origin, min(source) AS source FROM items JOIN origin USING (id) GROUP BY ALL),
c AS (SELECT story_id, count(*) AS o, count(DISTINCT source) AS d FROM s GROUP BY story_id),
p AS (SELECT story_id, bool_or(source_class = 'social') AND bool_or(source_class IN ('authoritative', 'primary')) AS m FROM items GROUP BY story_id)
SELECT story_id, o AS independent_origins, d AS distinct_sources, CASE WHEN m THEN 'primary_backed' WHEN o >= 3 AND d >= 2 THEN 'corroborated' ELSE 'rumor' END AS trust_state FROM c JOIN p USING (story_id)""")
def trust_state_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of stories of three kinds, so that every state occurs."""
    rows = mixed(spark, sf_dir)
    return provenance.trust_states(rows, links(rows), keys=provenance.shared_keys(copies=True))


@query(f"WITH {MIXED_ITEMS} SELECT story_id, bool_or(source_class = 'social') AND bool_or(source_class IN ('authoritative', 'primary')) AS primary_matched FROM items GROUP BY story_id")
def primary_in_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.primary_in_story(mixed(spark, sf_dir))


#: Reach within every prefix of every story: i is the number of its last item.
REPLAY = f"""{ORIGINS.split("reach AS")[0]} placed AS (SELECT story_id, id, source, source_class, row_number() OVER (PARTITION BY story_id ORDER BY ts, id) - 1 AS seq FROM items),
prefix AS (SELECT l.story_id, l.id AS last, l.seq AS i, p.id, p.source, p.source_class FROM placed l JOIN placed p ON p.story_id = l.story_id AND p.seq <= l.seq),
paths AS (SELECT l.seq AS i, l.story_id, a, b FROM hops JOIN placed x ON x.id = a JOIN placed y ON y.id = b JOIN placed l ON l.story_id = x.story_id AND y.story_id = x.story_id AND l.seq >= x.seq AND l.seq >= y.seq),
reach AS (SELECT story_id, i, id AS a, id AS b FROM prefix UNION SELECT r.story_id, r.i, r.a, p.b FROM reach r JOIN paths p ON p.story_id = r.story_id AND p.i = r.i AND p.a = r.b),
origin AS (SELECT story_id, i, a AS id, min(b) AS origin FROM reach GROUP BY ALL),
one AS (SELECT story_id, i, origin, min(CASE WHEN source <> '' THEN source END) AS source FROM origin JOIN prefix USING (story_id, i, id) GROUP BY ALL),
judged AS (SELECT story_id, i, count(*) AS o, count(DISTINCT source) AS d FROM one GROUP BY ALL),
official AS (SELECT story_id, last, i, bool_or(source_class = 'social') AND bool_or(source_class IN ('authoritative', 'primary')) AS m FROM prefix GROUP BY ALL),
replayed AS (SELECT story_id, last AS id, i AS seq, o, d, max(CASE WHEN i = 0 THEN 0 WHEN m THEN 2 WHEN o >= 3 AND d >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY story_id ORDER BY i) AS state FROM judged JOIN official USING (story_id, i))"""
CANDIDATES = "candidates AS (SELECT story_id, id FROM replayed WHERE seq > 0 AND o >= 2)"


def _replayed(rows: DataFrame) -> DataFrame:
    return provenance.replay(rows, links(rows), provenance.shared_keys(copies=True))


@query(f"WITH RECURSIVE {REPLAY.replace(COPIED_ITEMS, MIXED_ITEMS)} SELECT story_id, id, CAST(seq AS INTEGER) AS seq, CAST(o AS INTEGER) AS independent_origins, CAST(d AS INTEGER) AS distinct_sources, (['rumor', 'corroborated', 'primary_backed'])[state + 1] AS trust_state FROM replayed")
def trust_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after every item, of stories of three kinds."""
    return _replayed(mixed(spark, sf_dir))


@query(f"WITH RECURSIVE {REPLAY}, {CANDIDATES} SELECT story_id, id FROM candidates")
def candidate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.candidates(_replayed(wired(spark, sf_dir))).select("story_id", "id")


@query(rf"""WITH RECURSIVE {REPLAY}, {CANDIDATES}, t AS (SELECT story_id, id AS item_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM candidates JOIN documents ON doc_id = id),
s AS (SELECT story_id, item_id, string_split(CASE WHEN regexp_matches(t, '[.!?]\s') THEN regexp_extract(t, '^((?s:.*?)[.!?])\s', 1) ELSE t END, chr(10))[1] AS c FROM t)
SELECT story_id, item_id, left(trim(c), 2048) AS claim FROM s WHERE trim(c) <> ''""")
def extracted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of candidates by the stand-in for a chat model."""
    from undertow.operators import entities

    wanted = provenance.candidates(_replayed(wired(spark, sf_dir))).select("story_id", F.col("id").alias("item_id"))
    texts = items(spark, sf_dir).select(F.col("id").alias("item_id"), "text")
    return entities.claims(wanted.join(texts, "item_id"), entities.first_sentence)


# --- neighbours and stories over embeddings: vectors of one label share an entity, ten minutes apart

VECTORS = f"""v AS (SELECT vec_id AS id, {START} + vec_id * 600 AS ts, [CAST(label % 4 AS VARCHAR)] AS entities, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
pairs AS (SELECT x.id, y.id AS neighbour, list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) AS similarity
  FROM v x JOIN v y ON (y.ts < x.ts OR y.ts = x.ts AND y.id < x.id) AND y.ts >= x.ts - 172800),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS place FROM pairs) WHERE place <= 10),
fits AS (SELECT n.id, arg_min(n.neighbour, n.place) AS parent FROM near n JOIN v x ON x.id = n.id JOIN v y ON y.id = n.neighbour WHERE similarity >= 0.3 AND list_has_any(x.entities, y.entities) GROUP BY n.id),
parents AS (SELECT v.id AS node, coalesce(parent, v.id) AS parent FROM v LEFT JOIN fits ON v.id = fits.id)"""
FOREST = f"{VECTORS}, up AS (SELECT node, parent, 0 AS hop FROM parents UNION ALL SELECT up.node, p.parent, hop + 1 FROM up JOIN parents p ON up.parent = p.node WHERE p.parent <> up.parent), formed AS (SELECT node AS id, arg_max(parent, hop) AS story_id FROM up GROUP BY node)"
THETA = 0.3


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(n.alias("id"), (START + n * 600).alias("ts"), F.array((F.col("label") % 4).cast("string")).alias("entities"), "embedding", F.concat(F.lit("s"), (n % 5).cast("string")).alias("source"))


@query(f"WITH {VECTORS} SELECT id, neighbour, round(similarity, 6) AS similarity, place FROM near")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return story_ops.nearest(vectors(spark, sf_dir)).select("id", "neighbour", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


@query()
def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate: those of knn_topk that are similar enough and share a bucket of hyperplane signs."""
    return story_ops.nearest_lsh(vectors(spark, sf_dir), THETA).select("id", "neighbour", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {VECTORS} SELECT node, parent FROM parents")
def choose_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return story_ops.parents(rows, story_ops.nearest(rows), THETA)


@query(f"WITH RECURSIVE {FOREST} SELECT id, story_id FROM formed")
def story_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return story_ops.formed(vectors(spark, sf_dir), THETA, exact=True)


FOLD = f"""{FOREST} SELECT story_id, count(*) AS n_items, min(ts) AS first_seen, max(ts) AS last_seen, array_to_string(list_sort(list_distinct(flatten(list(entities)))), ',') AS entity_set,
array_to_string(list_sort(list(DISTINCT 's' || (id % 5))), ',') AS source_set, round(arg_min(e[1], ts), 6) AS head FROM formed JOIN v USING (id) GROUP BY story_id"""


def shown_folds(out: DataFrame) -> DataFrame:
    return out.select("story_id", "n_items", "first_seen", "last_seen", F.array_join("entity_set", ",").alias("entity_set"), F.array_join("source_set", ",").alias("source_set"), F.round(F.get("centroid", F.lit(0)).cast("double"), 6).alias("head"))


@query(f"WITH RECURSIVE {FOLD}")
def story_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    formed = story_ops.formed(rows, THETA, exact=True)
    return shown_folds(story_ops.folded(rows.join(formed, "id")))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT a.vec_id AS id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from undertow.functions.vector import cosine

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id").select(F.col("vec_id").alias("id"), F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))
