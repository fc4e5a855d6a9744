"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for every operator."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from bulletin.llm import bpe, maxent, media, mixing, neardup, sharding, substrings, tools, topk, toxicity

LONG = "wort " * 60_000
ROWS = [
    (1, None, None), (2, "", "a"), (3, "   \n", "a"), (4, "One two three four five six " * 20, "b"), (5, "One two three four five six " * 20, "b"),
    (6, "x", None), (7, LONG, "b"), (7, LONG, "b"), (None, "no id " * 30, "a"), (9, "é한😀 " * 40, None), (10, "idiot you are", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    clash = ("size", "shard", "hub", "key", "n", "h", "token_ids", "score", "node", "block", "salt", "taken", "target", "kept", "digest")
    return df.select("*", F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"), *[F.lit("clash").alias(c) for c in clash])


def labels(spark):
    return spark.createDataFrame([(4, 0, 0), (10, 0, 1), (None, 1, 1), (6, 0, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "sharding": lambda s, d: sharding.shard_documents(d, 3),
    "mixing": lambda s, d: mixing.taken(d),
    "substrings": lambda s, d: substrings.digests(d),
    "maxent": lambda s, d: maxent.score(d),
    "neardup": lambda s, d: neardup.near_duplicates(d),
    "bpe": lambda s, d: bpe.digests(d),
    "media": lambda s, d: media.media_columns(d),
    "toxicity": lambda s, d: toxicity.score(d, labels(s)),
}


WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
n_bytes = lambda t: len((t or "").encode())
n_words = lambda t: len(WORD.findall(t or ""))


def shingles(text):
    w = WORD.findall((text or "").lower())
    return len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) > 2 else int(bool(w))


#: By operator, what of a row its own text decides.
VALUES = {
    "sharding": (lambda r: (r["size"], r.text_crc32, r.law, r.grown_shard), lambda d, t: (n_bytes(t) + 16, zlib.crc32((t or "").encode()), "rows", None)),
    "mixing": (lambda r: (r["size"], r.taken % max(1, r["size"])), lambda d, t: (n_words(t), 0)),
    "substrings": (lambda r: (r.n_bytes, r.n_removed, r.n_spans), lambda d, t: (n_bytes(t), *((n_bytes(t), 1) if d == 5 else (0, 0)))),
    "maxent": (lambda r: (r.held_out, r.n_tokens), lambda d, t: (zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2, n_words(t) + 1)),
    "neardup": (lambda r: (r.n_shingles, r.component_id, r.kept), lambda d, t: (shingles(t), 4 if d == 5 else d, d != 5)),
    "bpe": (lambda r: (r.decoded_sha256, r.n_tokens > 0), lambda d, t: (sha(t), bool(t))),
    "media": (lambda r: (r.n_bytes, r.payload_bytes % 192, r.payload_bytes >= max(192, r.n_bytes)), lambda d, t: (n_bytes(t), 0, True)),
    "toxicity": (lambda r: (r.held_out, 0 <= r.score <= 1, r.predicted == int(r.score >= 0.5)), lambda d, t: (zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0, True, True)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, docs, name):
    got, want = VALUES[name]
    out = OPERATORS[name](spark, docs).collect()
    assert sorted(repr((r.doc_id, got(r))) for r in out) == sorted(repr((d, want(d, t))) for d, t, _ in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [0.5, 0.25]), (50, [0.5, None]), (100, None), (150, [nan, 1.0]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [1.0, 1.0]), (3, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit("clash"))
    got = [(r.query_id, r["rank"], r.vec_id) for r in topk.embeddings_top_k(df).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert topk.embeddings_top_k(df.limit(0)).count() == 0


def test_odd_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "assistant", "alone"), (None, 0, "user", "x"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("status", F.lit("clash"))
    got = sorted((r.kind, r.status) for r in tools.link_dialogues(df).collect())
    assert got == [("call", "answered"), ("call", "duplicate"), ("result", "linked"), ("result", "orphan"), ("result", "orphan"), ("result", "orphan")]
    assert tools.link_dialogues(df.limit(0)).count() == 0


def spread(spark, docs, shards):
    """Of each text, in how many shards it is; row counts of the shards are at most one apart."""
    got = sharding.shard_documents(docs, shards).join(docs, "doc_id")
    counts = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(counts) == shards and max(counts) - min(counts) <= 1
    return {r.text: (r.n, r.shards) for r in got.groupBy("text").agg(F.count("*").alias("n"), F.countDistinct("shard").alias("shards")).collect()}


def test_large_group_is_cut_no_more_than_quotas_ask(spark):
    ids = spark.range(400_000).withColumnRenamed("id", "doc_id")
    n, found = spread(spark, ids.withColumn("text", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("doc_id").cast("string"))), 40)["hot"]
    assert n == 133_334 and found <= 15


def test_groups_stay_whole_where_every_row_has_a_copy(spark):
    pairs = spread(spark, spark.range(4000).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / 2).cast("string").alias("text")), 10)
    assert all(shards == 1 for _, shards in pairs.values())
    many = spread(spark, spark.range(60_000).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / 2).cast("string").alias("text")), 10)
    assert sum(shards > 1 for _, shards in many.values()) == 0
    sixths = spread(spark, spark.range(6000).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / 600).cast("string").alias("text")), 6)
    assert sum(shards == 1 for _, shards in sixths.values()) >= 6


def test_pipeline_drops_rows_not_ids(spark):
    import corpus_pipeline as P

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    called = toxicity.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).join(docs, "doc_id").select("text", "predicted")
    bad, good = (called.where(F.col("predicted") == y).select(F.lit(None).cast("long").alias("doc_id"), "text").limit(1).collect() for y in (1, 0))
    nameless = spark.createDataFrame(bad + good, "doc_id long, text string")
    assert [r.text for r in P.drop_toxic(spark, docs.unionByName(nameless), folder).where("doc_id is null").collect()] == [good[0].text]
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (1, a), (None, b), (5, c), (5, c), (1, b + " end")]
    got = P.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, a), (1, b + " end"), (5, c)]


def test_a_copy_does_not_take_its_namesake_with_it(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in ("left", "right"))
    rows = [(3, a), (7, a), (7, b), (9, "new " * 20 + b)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes - r.n_removed) for r in got) == [(3, len(a)), (7, 0), (7, len(b)), (9, 80)]
