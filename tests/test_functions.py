"""Column functions on single values."""

from __future__ import annotations

import random

import math

import pytest
from pyspark.sql import functions as F

from undertow.functions import series, text, url, vector
from undertow.functions.geo import haversine_km, mean_vertex
from undertow.operators import entities
from undertow.schemas import strict_json, valid_item, valid_tally


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def arr(*values):
    return F.array(*[F.lit(float(v)) for v in values])


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("https://WWW.Example.org/a/?utm_source=x&b=1&fbclid=2#top", "example.org/a?b=1"),
        ("http://example.org", "example.org"),
        ("http://u@example.org:80/p/", "u@example.org:80/p"),
        ("no url", ""),
        ("/only/path", ""),
        ("https://h/?a&b=", "h?a=&b="),
    ],
)
def test_canonical_url(spark, given, want):
    assert one(spark, url.canonical_url(F.lit(given))) == want == one(spark, url.canonical_url_exact(F.lit(given)))


def test_canonical_url_exact_writes_queries_anew(spark):
    assert one(spark, url.canonical_url_exact(F.lit("http://h/?q=a%20b"))) == "h?q=a+b"


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("ROME (AP) - it rained", "ap"), ("said Reuters", "reuters"), ("(CNN) as Reuters said", "cnn"), ("xReuters", ""), ("y" * 170 + "(AP)", ""), ("An (ap) tag", ""), ("Agence France-Presse", "afp"),
        ("", ""), (None, ""),
    ],
)
def test_wire_ref(spark, given, want):
    assert one(spark, text.wire_ref(F.lit(given).cast("string"))) == want


def test_relevance(spark):
    assert one(spark, text.relevance(F.lit("fired"))) == pytest.approx(0.6)
    assert one(spark, text.relevance(F.lit("x" * 81))) == pytest.approx(0.5)
    assert one(spark, text.composed_relevance(F.lit(0.8), F.lit(True), F.lit(2))) == 1.0


@pytest.mark.parametrize(("given", "want"), [("<p>a<br/>b</p>", "a\nb"), ("x &lt;b&gt; &amp;amp;", "x <b> &amp;"), ("<i></i>", "")])
def test_strip_html(spark, given, want):
    assert one(spark, text.strip_html(F.lit(given))) == want == one(spark, text.html_text(F.lit(given)))


def test_simhash_is_near_for_near_texts(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = spark.createDataFrame([(0, long), (1, long.replace("w7 ", "other ")), (2, "nothing alike at all here"), (3, ""), (4, None)], "id int, t string")
    for hashed in (text.simhash_blake2b("t"), text.simhash_md5(text.word_tokens(F.col("t")))):
        v = {r["id"]: r["h"] & (1 << 64) - 1 for r in rows.select("id", hashed.alias("h")).collect()}
        assert (v[0] ^ v[1]).bit_count() <= 6 < (v[0] ^ v[2]).bit_count() and v[3] == v[4] == 0


def test_signed_and_unsigned(spark):
    assert int(one(spark, text.unsigned(F.lit(-1).cast("long")))) == (1 << 64) - 1
    assert one(spark, text.hamming(F.lit(5).cast("long"), F.lit(6).cast("long"))) == 2


def test_shingles(spark):
    words = F.array(*map(F.lit, ["a", "b", "c"]))
    assert one(spark, text.shingles(words, 2)) == ["a b", "b c"]
    assert one(spark, text.shingles(words, 5)) == ["a b c"] and one(spark, text.shingles(F.array().cast("array<string>"), 2)) == []


def test_distances(spark):
    assert one(spark, haversine_km(*map(F.lit, (48.2, 16.4, 48.2, 16.4)))) == 0
    assert one(spark, haversine_km(*map(F.lit, (0.0, 0.0, 0.0, 180.0)))) == pytest.approx(math.pi * 6371)
    ring = F.array(arr(0, 0), arr(4, 0), arr(4, 4), arr(999, 0))
    assert one(spark, mean_vertex(ring)).asDict() == {"lat": pytest.approx(4 / 3), "lon": pytest.approx(8 / 3)}
    assert one(spark, mean_vertex(F.array(arr(999, 0)))) is None


def test_cosine(spark):
    assert one(spark, vector.cosine(arr(1, 0), arr(0, 2))) == 0 and one(spark, vector.cosine(arr(0, 0), arr(1, 1))) is None
    v = one(spark, vector.hash_embedding(384)(F.lit("x")))
    assert len(v) == 384 and sum(x * x for x in v) == pytest.approx(1, abs=1e-5)


def z(spark, values):
    return one(spark, series.z_of_last(series.acceleration(series.ewma(arr(*values)))))


def test_velocity(spark):
    assert one(spark, series.ewma(arr(1, 2))) == [1.0, pytest.approx(1.3)]
    assert one(spark, series.acceleration(arr(1, 2, 4))) == [1.0] and one(spark, series.acceleration(arr(1, 2))) == []
    assert z(spark, [5] * 20) == 0 and z(spark, [0] * 19 + [50]) == 10.0
    assert z(spark, [3, 4] * 10 + [60]) > 3 and z(spark, [0] * 10 + [50] * 9 + [0]) < 0


def test_gap_and_inauthenticity(spark):
    assert one(spark, series.gap_score(F.lit(-2.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) == 0
    assert one(spark, series.gap_score(F.lit(4.0), F.lit(0.5), F.lit(0.7), F.lit(0.5))) == pytest.approx(0.7)
    assert [one(spark, series.corroboration_weight(F.lit(s))) for s in ("rumor", "corroborated", "primary_backed")] == [0, 0.7, 1]
    score = lambda *v: one(spark, series.inauthenticity(*map(F.lit, v)))
    assert score(4, 1, 9, 4, 4) == 0 and score(10, 1, 0, 0, 0) == pytest.approx(0.27) and score(10, 0, 99, 10, 10) == pytest.approx(1)


def test_gazetteer(spark):
    phrases = ("new york", "york", "gaza")
    assert one(spark, entities.matches(F.lit("New-York, York! gazaX Gaza"), phrases)) == ["new york", "york", "gaza"]
    found = one(spark, entities.matcher(entities.SEED)(F.lit("new york and NEW YORK; kyiv")))
    assert [e["text"] for e in found] == ["New York", "New York", "Kyiv"]


def test_bio_and_wordpiece(tmp_path):
    text = "An Bo x Co Do U.S. An Bo"
    spans = [(0, 2), (3, 5), (6, 7), (8, 10), (11, 13), (14, 15), (15, 16), (16, 17), (17, 18), (19, 21), (22, 24)]
    marks = ["B-PER", "I-PER", "O", "I-ORG", "B-ORG", "B-LOC", "I-LOC", "I-LOC", "I-LOC", "B-PER", "I-PER"]
    assert entities.bio_entities(text, spans, marks) == [("An Bo", "PER"), ("Co", "ORG"), ("Do", "ORG"), ("U.S.", "LOC")]
    assert entities.bio_entities(text, spans, marks, entities.TAG_TYPES)[3] == ("U.S.", "place")
    pieces = entities.WordPiece(["[UNK]", "[CLS]", "[SEP]", "play", "##ing", "a", "p"])
    assert pieces.encode("a Playing zzz") == ([1, 5, 3, 4, 0, 2], [-1, 0, 1, 1, 2, -1])
    assert pieces.encode("a playing", most=4) == ([1, 5, 2], [-1, 0, -1])
    assert pieces.pieces("pl") == pieces.pieces("p" * 101) == ["[UNK]"] and pieces.pieces("p") == ["p"]
    words = entities.WordPiece(["[UNK]"])
    assert words.basic("Café, 東京tower $5\x00x_y") == ["cafe", ",", "東", "京", "tower", "$", "5", "x", "_", "y"]
    assert words.spans("a  東b") == [(0, 1), (3, 4), (4, 5)]
    (tmp_path / "vocab.txt").write_text("[UNK]\nÉa\n\nb\n", encoding="utf-8")
    assert entities.WordPiece.from_folder(str(tmp_path)).basic("Éa") == ["ea"] and entities.label_names(str(tmp_path)) == list(entities.CONLL)
    (tmp_path / "tokenizer_config.json").write_text('{"do_lower_case": false}')
    (tmp_path / "config.json").write_text('{"id2label": {"0": "O", "1": "B-X"}}')
    cased = entities.WordPiece.from_folder(str(tmp_path))
    assert cased.basic("Éa") == ["Éa"] and cased.ids == {"[UNK]": 0, "Éa": 1, "b": 3} and entities.label_names(str(tmp_path)) == ["O", "B-X"]
    (tmp_path / "labels.txt").write_text("O\nB-Y\n")
    assert entities.label_names(str(tmp_path)) == ["O", "B-Y"]


def test_pieces_equal_the_library():
    from tokenizers import BertWordPieceTokenizer

    vocabulary = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "b", "ab", "##a", "##b", "##ab", "##bc", "c", "東", "-", "'", "é", "e", "##e", "$"]
    library = BertWordPieceTokenizer({t: i for i, t in enumerate(vocabulary)}, lowercase=True)
    own = entities.WordPiece(vocabulary)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("aabbcé東-' $ABZ\t") for _ in range(rng.randint(0, 25)))
        assert own.encode(text)[0] == library.encode(text).ids, repr(text)


def test_padded_feeds():
    feed = entities.padded([[1, 2, 3], [4]], {"input_ids", "attention_mask"}, pad=9)
    assert feed["input_ids"].tolist() == [[1, 2, 3], [4, 9, 9]] and feed["attention_mask"].tolist() == [[1, 1, 1], [1, 0, 0]] and len(feed) == 2


def test_phrases_of_a_trie_equal_the_alternation(spark):
    rng = random.Random(6)
    phrases = {"a", "a b", "a b c d", "b c", "c", "d e"}
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 20))) for _ in range(200)]
    trie = entities.Phrases({p: p for p in phrases})
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    want = {r["id"]: list(r["m"]) for r in table.select("id", entities.matches(F.col("text"), phrases).alias("m")).collect()}
    assert {i: trie.find(t) for i, t in enumerate(texts)} == want


def test_validity(spark):
    base = {"id": "i", "source": "s", "source_class": "social", "lang": "en", "text": "t", "entities": [], "geo": None, "urls": [], "author_ref": "", "parent_ref": None, "content_hash": "h", "raw_ref": ""}
    ddl = "id string, source string, source_class string, lang string, text string, entities array<struct<text:string,type:string,geo:struct<lat:double,lon:double,geohash:string>>>, geo struct<lat:double,lon:double,geohash:string>, urls array<string>, author_ref string, parent_ref string, content_hash string, raw_ref string"
    cases = [({}, True), ({"source": "s" * 65}, False), ({"source_class": "x"}, False), ({"urls": ["u"] * 33}, False), ({"geo": {"lat": 91.0, "lon": 0.0, "geohash": None}}, False), ({"text": None}, False)]
    rows = spark.createDataFrame([base | c for c, _ in cases], ddl)
    assert [r[0] for r in rows.select(valid_item()).collect()] == [w for _, w in cases]
    tallies = spark.createDataFrame([({"a": 1}, 0.5), ({"a": -1}, 0.5), ({"": 1}, 0.5), ({"a": 1}, 1.5)], "counts map<string,int>, theta double")
    assert [r[0] for r in tallies.select(valid_tally()).collect()] == [True, False, False, False]


def test_unknown_fields_are_refused(spark):
    raw = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "b": 2}',), ('{"a": 1, "g": {"x": 1, "y": 2}}',), ("no json",)], "raw string")
    got = strict_json(raw, "raw", "a int, g struct<x:int>", {"$.g": "x int"}).select("well_formed").collect()
    assert [r[0] for r in got] == [True, False, False, False]


def test_a_deployment_is_told_by_the_environment(monkeypatch):
    from undertow.config import Store

    monkeypatch.setenv("UNDERTOW_FOLDER", "/data")
    monkeypatch.setenv("UNDERTOW_DAYS", "3")
    assert Store.from_env() == Store("/data", "one", 65_536, 3)
