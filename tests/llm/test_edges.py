"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm import embeddings, fingerprints, html, lm, mixing, neardup, packing, quality, substring, toxicity

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in ("rest", "chunk", "b", "sk", "size", "row", "kept", "rep", "p", "score", "fold", "y", "x", "end", "host", "answers")],
])
LONG = " ".join(f"word{i % 997}" for i in range(40_000))


def rows():
    more = (None,) * 16
    return [
        (1, "a b c d e f g", "en", "s", 13, *more), (2, None, None, None, None, *more), (3, "", "en", "s", 0, *more), (None, "no id here", "en", "s", 3, *more),
        (4, LONG, "en", "t", len(LONG), *more), (5, LONG, "en", "t", len(LONG), *more), (1, "a b c d e f g", "en", "s", 13, *more), (6, "\n \t\n", "en", None, 4, *more), (7, "é 日本 😀", "fr", "u", 6, *more),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, None), (5, 0, 1), (None, 1, 1), (5, 0, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")


def test_packing(spark, docs, none):
    got = packing.pack_documents(spark, docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert sum(r["length"] for r in by[2]) == 1 and by[3][0]["doc_tokens"] == 1  # only the end
    assert sum(r["length"] for r in by[1]) == 2 * by[1][0]["doc_tokens"]  # the repeated row is packed too
    assert None in by and packing.pack_documents(spark, none).count() == 0


def test_scores(spark, docs, none, labels):
    got = {r["doc_id"]: r for r in lm.score_documents(spark, docs).collect()}
    assert got[2]["n_tokens"] == 1 and got[2]["score"] < 0 and len(got) == 8
    assert lm.score_documents(spark, none).count() == 0
    for f in (quality.quality, toxicity.toxicity):
        r = f(spark, docs, labels).collect()
        assert len(r) == 9 and all(0 <= x["score"] <= 1 for x in r)
        assert f(spark, none, labels).count() == 0
        assert f(spark, docs, labels.limit(0)).count() == 9


def test_fingerprints(spark, docs, none):
    got = fingerprints.fingerprints(spark, docs).collect()
    assert len(got) == 9 and {r["n_chars"] for r in got if r["doc_id"] in (2, 3)} == {0}
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (4, 5)}) == 1
    assert fingerprints.fingerprints(spark, none).count() == 0
    one = fingerprints.fingerprints(spark, docs.where("doc_id = 7")).collect()
    assert one[0]["near_next"] == 1.0  # the only document is its own next one


def test_near_copies(spark, docs, none):
    got = neardup.linked(spark, docs, words=3, threshold=0.85).collect()
    assert len(got) == 9
    by = {r["doc_id"]: r for r in got}
    assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[2]["n_shingles"] == 0 and by[3]["component_id"] == 3
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert neardup.linked(spark, none).count() == 0
    kept = neardup.without_near_copies(spark, docs, words=3, threshold=0.85)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "None"]
    two = spark.createDataFrame([(1, "one text of some words", "a"), (1, "another one, quite unlike it", "a"), (1, "one text of some words", "a"), (2, "one text of some words", "b")], "doc_id long, text string, `a.b` string")
    assert sorted(r["text"][:3] for r in neardup.without_near_copies(spark, two).collect()) == ["ano", "one"]  # rows of one id stay together


def test_dotted_and_clashing_names(spark, docs):
    odd = docs.select("doc_id", "text", "source", "n_chars", F.lit("x").alias("a.b"), F.lit("y").alias("uid"), F.lit("z").alias("pass"))
    assert mixing.mixed_texts(spark, odd).columns == odd.columns and mixing.mixed_texts(spark, odd).count() > 0
    out = substring.remove_repeats(spark, odd, rest=["a.b", "uid", "pass"])
    assert out.select("rest.`a.b`").distinct().collect()[0][0] == "x" and neardup.without_near_copies(spark, odd).columns == odd.columns


def test_repeats(spark, docs, none):
    got = substring.remove_repeats(spark, docs).collect()
    assert len(got) == 9
    by = {r["doc_id"]: r for r in got}
    assert by[5]["n_removed"] == 40_000 and by[5]["kept"] == "" and by[4]["n_removed"] == 0 and by[2]["n_words"] == 0
    assert substring.remove_repeats(spark, none).count() == 0


def test_mixing(spark, docs, none):
    m = mixing.mix(spark, docs)
    taken = {r["uid"]: r["t"] for r in m.placed().groupBy("uid").agg(F.sum("words").alias("t")).collect()}
    for r in m.rows.collect():
        assert 0 <= taken.get(r["uid"], 0) <= 2 * r["size"]
    assert m.rows.count() == 9 and mixing.mix(spark, none).rows.count() == 0
    texts = mixing.mixed_texts(spark, docs)
    assert texts.columns == docs.columns and mixing.mixed_texts(spark, none).count() == 0


def test_embeddings(spark):
    v = [1.0] + [0.0] * 7
    data = [(1, v), (2, v), (3, [x * 5 for x in v]), (4, None), (5, [0.0] * 8), (6, [float("nan")] + v[1:]), (7, [None] + v[1:]), (8, []), (9, [1.0]), (None, v), (1, v)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("h", F.lit("x"))
    got = embeddings.linked(spark, df).collect()
    by = {r["vec_id"]: r for r in got}
    assert len(got) == 11 and by[3]["component_id"] == 1 and by[3]["n_links"] == 3 and by[2]["n_links"] == 3
    assert all(by[k]["n_links"] == 0 and by[k]["component_id"] == k for k in (4, 5, 6, 7, 8, 9)) and by[None]["n_links"] == 0
    assert embeddings.linked(spark, df.limit(0)).count() == 0


def test_pages(spark):
    data = [(1, "http://a.b/c", "<html><body><nav>menu</nav><p>x &amp; y</p></body></html>"), (2, None, None), (3, "odd", ""), (4, "http://a.b/d", "plain text"), (4, "http://a.b/d", "plain text"), (5, "http://a.b/e", "<p>cut off <b"), (6, "http://c.d", "<div>" * 300 + "deep")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("t"))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.main_texts(spark, df).collect())
    assert got == [(1, "x & y", 5), (2, "", 0), (3, "", 0), (4, "plain text", 10), (4, "plain text", 10), (5, "cut off", 7), (6, "deep", 4)]
    assert html.main_texts(spark, df.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, none):
    """Odd rows and an empty table through every stage."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        kept[name] = out.count()
        assert name == "packing" or out.columns == docs.columns
        assert stage(spark, none, sf).count() == 0
    # Nothing here is toxic; the copies of one text and of one row go; empty texts take no part in a mix.
    assert (kept["toxicity"], kept["near_dedup"], kept["substring_dedup"]) == (9, 7, 9) and kept["mixing"] >= 4 and kept["packing"] >= 9
