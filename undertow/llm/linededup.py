"""Line dedup by winnowing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import frozen, keyed, same_document, text_key, whole

#: What separates words within a line.
BLANK = "[ \t\x0b\f\r]+"


def selected(size: int, words: int) -> F.Column:
    """The fingerprints of a document's windows of size lines, each (size, at, windows), by its columns of documents().

    at is the least line hash of a window, the last of equal ones; windows (start, content) are those of which that
    line is the least. Each window has one fingerprint, and neighbouring windows, as a rule, the same one. With words,
    only windows of at least so many count.
    """
    last = F.size("ut_hash") - size
    least = lambda s: F.array_min(F.transform(F.sequence(s, s + size - 1), lambda i: F.struct(F.get("ut_hash", i).alias("h"), (-i).alias("p"))))
    chosen = F.transform(F.sequence(F.lit(0), last), lambda s: -least(s)["p"]) if size > 1 else F.sequence(F.lit(0), last)
    content = lambda s: F.unhex(F.substring(F.sha2(F.array_join(F.slice("ut_lines", s + 1, size), "\n"), 256), 1, 32))

    def own(at, among) -> F.Column:
        near = F.sequence(F.greatest(F.lit(0), at - (size - 1)), F.least(at, last))
        fits = lambda s: F.get(among, s) == at
        if words:
            enough = lambda s: sum((F.get("ut_words", s + j) for j in range(1, size)), F.get("ut_words", s)) >= words
            starts = F.filter(near, lambda s: fits(s) & enough(s))
        else:
            starts = F.filter(near, fits)
        return F.struct(F.lit(size).alias("size"), at.alias("at"), F.transform(starts, lambda s: F.struct(s.alias("start"), content(s).alias("content"))).alias("windows"))

    # the one-element array hands the chosen lines on, so that they are computed once
    prints = F.flatten(F.transform(F.array(chosen), lambda among: F.transform(F.array_distinct(among), lambda at: own(at, among))))
    none = F.expr("array()").cast("array<struct<size:int,at:int,windows:array<struct<start:int,content:binary>>>>")
    return F.when(last >= 0, F.filter(prints, lambda p: F.size(p["windows"]) > 0)).otherwise(none)


def fingerprints(docs: DataFrame, window: int, words: int | None = None) -> DataFrame:
    """doc_id, ut_text_key, mark (hash of a selected line), size, at, windows: see selected. Windows of window lines count
    all, and with words shorter ones of so many words."""
    lines = docs.select(*text_key(), F.split("text", "\n", -1).alias("ut_lines")).where("ut_lines is not null")
    counted = F.transform("ut_lines", lambda x: F.size(F.filter(F.split(x, BLANK), lambda w: w != "")))
    ready = lines.select("*", F.transform("ut_lines", lambda x: F.xxhash64(x)).alias("ut_hash"), *([counted.alias("ut_words")] if words else []))
    prints = [selected(window, 0), *(selected(size, words) for size in range(1, window) if words)]
    rows = ready.select("doc_id", "ut_text_key", "ut_hash", F.explode(F.concat(*prints) if len(prints) > 1 else prints[0]).alias("p"))
    return rows.select("doc_id", "ut_text_key", F.get("ut_hash", F.col("p.at")).alias("mark"), "p.size", "p.at", "p.windows")


def repeated_lines(docs: DataFrame, window: int, words: int | None = None) -> DataFrame:
    """doc_id, ut_text_key, ut_gone: the sorted numbers of the lines in windows that stand earlier."""
    rows = frozen(fingerprints(docs, window, words))
    # positions are joined on marks that stand twice at least; these are counted before the shuffle, so that a very
    # frequent line is one row a task
    shared = frozen(rows.groupBy("size", "mark").agg(F.count("*").alias("n")).where("n > 1").select("size", "mark"))  # written, so that the join can split a frequent mark
    met = rows.join(shared, ["size", "mark"], "left_semi").select("doc_id", "ut_text_key", "size", F.explode("windows").alias("w")).select("doc_id", "ut_text_key", "size", "w.start", "w.content")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    first = frozen(met.groupBy("size", "content").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = met.join(first, ["size", "content"]).where(place > F.col("first"))
    runs = later.groupBy("doc_id", "ut_text_key").agg(F.collect_set(F.struct("start", "size")).alias("r"))
    return runs.select("doc_id", "ut_text_key", F.array_sort(F.array_distinct(F.flatten(F.transform("r", lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1))))).alias("ut_gone"))


def dedup_lines(docs: DataFrame, window: int = 3, words: int | None = 50) -> DataFrame:
    """docs, with all its columns, and in text only the lines that belong to no later repeated run.

    A run is window or more consecutive lines, or fewer of words or more words in all (none, if words is null), that
    also stand, in this order, at an earlier place: in a document with a smaller doc_id, or further up in the same one.
    Such lines go; the others stay, joined by a newline. The first place keeps its lines, whatever the number of later
    ones. Lines are compared unchanged; the input decides, not what is left. A null text stays null, an empty one is a
    line without words, and one whose lines all go is ''. Texts of any length are read whole, in time linear in their
    lines. Rows with one doc_id and text are no repeats of each other and lose the same lines; rows without doc_id come
    after all others. An empty table gives one. n_lines and n_removed are added, in place of columns so named; no other
    name clashes.

    Winnowing: of each window of lines one line is selected, and two equal windows select the same one. Only selected
    lines travel, one row each. Those whose hash stands twice at least are extended to the windows that they stand
    for, on the lines both ways, and equality is verified by 128 bits of the windows' SHA-256; the later ones are grown, window by
    window, into the repeated run. The first place of a window is aggregated before the shuffle and joined back, so a
    line however frequent costs its own rows and no pairs.
    """
    out = _kept(keyed(docs.drop("n_lines", "n_removed")), docs, window, words)
    return out.select("ut_row.*", F.col("ut_n").alias("n_lines"), F.col("ut_m").alias("n_removed"))


def without_repeats(docs: DataFrame, window: int = 3, words: int | None = 50) -> DataFrame:
    """docs as dedup_lines cleans them, with its own columns and no others, be they named as they may."""
    return whole(_kept(keyed(docs), docs, window, words))


def _kept(rows: DataFrame, docs: DataFrame, window: int, words: int | None) -> DataFrame:
    """ut_row with the text cleaned, and how many lines it had (ut_n) and lost (ut_m)."""
    joined = same_document(rows, repeated_lines(docs, window, words), "left")
    lines = F.split("ut_row.text", "\n", -1)
    # the stretches between those that go
    opens = F.filter("ut_gone", lambda x, i: (i == 0) | (F.get("ut_gone", i - 1) < x - 1))
    shuts = F.transform(F.filter("ut_gone", lambda x, i: (i == F.size("ut_gone") - 1) | (F.get("ut_gone", i + 1) > x + 1)), lambda x: x + 1)
    ready = joined.select("ut_row", "ut_gone", lines.alias("ut_lines"), F.concat(F.array(F.lit(0)), shuts).alias("ut_from"), opens.alias("ut_to"))
    stretches = F.zip_with("ut_from", F.concat("ut_to", F.array(F.size("ut_lines"))), lambda a, b: F.slice("ut_lines", a + 1, b - a))
    kept = F.when(F.col("ut_gone").isNull(), F.col("ut_row.text")).otherwise(F.array_join(F.flatten(stretches), "\n"))
    added = F.coalesce(F.size("ut_lines"), F.lit(0)), F.coalesce(F.size("ut_gone"), F.lit(0))
    out = ready.select(F.col("ut_row").withField("text", kept).alias("ut_row"), added[0].alias("ut_n"), added[1].alias("ut_m"))
    return out.select("ut_row", *[F.greatest(F.col(c), F.lit(0)).alias(c) for c in ("ut_n", "ut_m")])


#: The result of dedup_lines(window=3, words=50) over documents: doc_id, n_lines, n_removed, text.
SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
x AS (SELECT doc_id, a, list_transform(a, lambda y: len(list_filter(regexp_split_to_array(y, '[ \t\x0B\f\r]+'), lambda z: z <> ''))) AS n FROM l),
s AS (SELECT doc_id, a, n, k, unnest(range(1, len(a) - k + 2)) AS s FROM x, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(a) >= k),
w AS (SELECT doc_id, k, s, a[s:s + k - 1] AS g FROM s WHERE k = 3 OR list_sum(n[s:s + k - 1]) >= 50),
r AS (SELECT doc_id, k, s, row_number() OVER (PARTITION BY k, g ORDER BY doc_id, s) AS n FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS p FROM r WHERE n > 1),
e AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS p FROM l),
k AS (
  SELECT e.doc_id, count(*) AS n_lines, count(g.p) AS n_removed,
         coalesce(string_agg(e.line, chr(10) ORDER BY e.p) FILTER (WHERE g.p IS NULL), '') AS text
  FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT l.doc_id, CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed,
       coalesce(k.text, l.text) AS text
FROM l LEFT JOIN k ON l.doc_id = k.doc_id
"""
