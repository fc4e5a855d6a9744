"""Operators against brute force, round trips and what their methods promise."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bulletin.llm import bpe, bytesops, media, neardup, queries, substrings
from bulletin.llm.suffixes import equal_windows, suffix_array

FOLDER = "/root/testdata/sf0.001"


def texts():
    t = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.randint(1, 3) for _ in range(rng.randint(0, 30))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    s = np.array([1, 2, 1, 2, 1, 3])
    assert list(equal_windows(s, np.array([0, 2, 4]), 2)) == [0, 0, 1]


def test_words_and_hashes():
    import pyarrow as pa

    t = [" a b", None, "", "é b  a\x0bA"]
    data, offsets = bytesops.laid_out(pa.array(t))
    data = bytesops.lowered(data)
    starts, ends, first = bytesops.words(data, offsets)
    assert [data[i:j].tobytes() for i, j in zip(starts, ends)] == [w for x in t for w in (x or "").encode().lower().split()]
    h = bytesops.digests(data, starts, ends)
    assert h[0] == h[4] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_word_hashes_tell_structured_words_apart():
    import pyarrow as pa

    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    data, offsets = bytesops.laid_out(pa.array([one, other, one, one[:1023], "x" * 9, "x" * 8 + "y"]))
    h = bytesops.digests(data, offsets[:-1], offsets[1:]).tolist()
    assert h[0] == h[2] and len(set(h)) == 5 and h[0] != bytesops.digests(data, offsets[:1], offsets[1:2], 1)[0]


def test_bpe_equals_library():
    import public_tokenizers as P
    import tiktoken

    pairs = bpe.load()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    for t in [*texts().values(), "", "a" * 500, "한국어 😀 é", " \n\n  x"]:
        ids = pairs.encode(t or "")
        assert ids == library.encode_ordinary(t or "") and pairs.decode(ids) == (t or "").encode()


def test_media_round_trip():
    for t in (b"", b"x", b"y" * 192, bytes(range(256)) * 9):
        payload = media.padded(t)
        stored = media.encoded(payload)
        assert media.decoded(stored) == payload and media.header(stored[: media.HEADER]) == (192, len(payload) // 192, 8, 0)


def test_substrings_brute_force(spark):
    first, want = {}, {}
    for d, t in sorted(texts().items()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], d) < d:
                gone[i : i + 50] = b"\1" * 50
        want[d] = bytes(x for x, g in zip(b, gone) if not g)
    got = {r.doc_id: bytes(r.kept) for r in substrings.remove_repeats(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    assert got == want


def chain():
    """A chain of texts each alike to the next, whose ends aren't alike; a hub of edits; a text alone."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    out = {0: base}
    for i in range(1, 6):
        out[i] = list(out[i - 1])
        out[i][i * 15] = f"new{i}"
    for i in range(6, 30):
        out[i] = list(base)
        out[i][i * 4 % 120] = f"edit{i}"
    out[30] = [f"z{i}" for i in range(50)]
    return {i: " ".join(w) for i, w in out.items()}


def test_near_duplicates_brute_force(spark):
    t = chain()
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in ((i, x.split()) for i, x in t.items())}
    label = {i: i for i in t}
    for _ in t:
        for a in t:
            for b in t:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert got == label


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    h = bytesops.mixed(rng.integers(0, 2**63, 3000).astype(np.uint64))
    a, b = h[:2500], h[500:]
    s = neardup.registers(np.concatenate([a, b, h]), np.array([0, 2500, 5000, 8000]))
    assert (neardup.merged(s[0], s[1]) == s[2]).all()
    j = neardup.estimated(np.array([(s[0] > s[1]).sum()]), np.array([(s[0] < s[1]).sum()]), np.array([2500.0]), np.array([2500.0]))[0]
    assert abs(j - 2000 / 3000) < 0.15


@pytest.mark.parametrize("name", ["op2_tool_call_linking", "op3_kd_tree_top_k", "op4_hash_threshold_mixing"])
def test_equals_sql(spark, name):
    import glob
    import os

    import duckdb

    from bulletin.llm.sql import ORACLES

    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, want = queries.QUERIES[name](spark, FOLDER), con.sql(ORACLES[name])
    plain = lambda cols, rs: sorted(repr([round(float(r[i]), 6) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in sorted(range(len(cols)), key=lambda i: cols[i])]) for r in rs)
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain(want.columns, want.fetchall())
    assert sorted(df.columns) == sorted(want.columns)


def test_shards(spark):
    got = queries.QUERIES["op1_balanced_label_propagation"](spark, FOLDER).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    shards = {}
    for r in got:
        shards.setdefault(texts()[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_model_beats_base_on_held_out_texts(spark):
    got = queries.QUERIES["op6_hashed_maxent"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = queries.QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    right = lambda y: sum(r.predicted == y for r in got if r.toxic == y) / sum(r.toxic == y for r in got)
    assert right(1) > 0.85 and right(0) > 0.97


def test_the_token_before_tells_words_of_a_class_apart(spark):
    from bulletin.llm import maxent

    # Words with one ending, so of one class; each has a word of its own before it, and both are as frequent.
    words = [f"{a}{b}ing" for a in "bcdfghjklm" for b in "aeiou"] + [f"{a}{b}{c}ung" for a in "bcdf" for b in "aeiou" for c in "lm"]
    after = {w: words[(i * 7 + 3) % len(words)] for i, w in enumerate(words)}
    rng = random.Random(5)
    line = lambda: " ".join(f"{w} {after[w]}" for w in rng.choices(words, k=40))
    right, wrong = " ".join(f"{w} {after[w]}" for w in words), " ".join(f"{w} {after[words[(i + 1) % len(words)]]}" for i, w in enumerate(words))
    rows = [(i, line()) for i in range(3000)]
    ids = [i for i in range(5000, 6000) if __import__("zlib").crc32(str(i).encode()) % 7 == 2][:2]
    df = spark.createDataFrame(rows + [(ids[0], right), (ids[1], wrong)], "doc_id long, text string")
    got = {r.doc_id: r for r in maxent.score(df).where(F.col("doc_id").isin(ids)).collect()}
    a, b = got[ids[0]], got[ids[1]]
    assert a.held_out and b.held_out and abs(a.base_score - b.base_score) < 1e-6
    assert a.score > b.score + 50
