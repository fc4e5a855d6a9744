"""Operators and pipeline stages held against plain Python: values, not shapes."""

import hashlib
import itertools
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bulletin.llm import bpe, maxent, media, neardup, sharding, substrings, tools, topk, toxicity

FOLDER = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, width):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def groups(sets, part):
    """The smallest position of each set's component, by comparing every two sets with a common shingle."""
    at, by = list(range(len(sets))), {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, s in enumerate(sets):
        both = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if 100 * n >= part * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return [root(i) for i in range(len(sets))]


# ---- Near-duplicates ----


def test_near_duplicates_of_the_test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    sets = [shingles(t, 3) for _, t in rows]
    want = groups(sets, 85)
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    for (doc, _), s, w in zip(rows, sets, want):
        assert (got[doc].n_shingles, got[doc].component_id, got[doc].kept) == (len(s), rows[w][0], rows[w][0] == doc)


def test_links_through_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(200)]
    near, nearer, far = base[:190], base[:180], [f"z{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (None, " ".join(near)), (3, " ".join(nearer)), (5, " ".join(far)), (5, " ".join([*far[:97], "a", "b", "c"])), (7, " ".join([*base[:199], "end"])), (7, "alone"), (None, "lone words here too")]
    part = 93  # 1 and 3 meet by the row without doc_id alone
    for order in itertools.islice(itertools.permutations(rows), 0, 40320, 20000):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in neardup.near_duplicates(spark.createDataFrame(list(order), "doc_id long, text string"), part=part).collect())
        sets = [shingles(t, 3) for _, t in order]
        want = groups(sets, part)
        ids = {w: min((d for (d, _), x in zip(order, want) if x == w and d is not None), default=None) for w in want}
        assert got == sorted((str(d), len(s), str(ids[w])) for (d, _), s, w in zip(order, sets, want))


def test_one_of_each(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    want = groups([shingles(t, 5) for _, t in rows], 80)
    got = neardup.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [rows[i][0] for i in sorted(set(want))]


def test_merges_join_what_all_links_join():
    rng = random.Random(2)
    for _ in range(60):
        m = rng.randint(2, 14)
        sets = [np.array(sorted(rng.sample(range(14), rng.randint(1, 10))), np.uint64) for _ in range(m)]
        label, side = np.array([rng.randint(0, 5) for _ in range(m)]), np.array([rng.choice([0, 1]) if m % 2 else 2 for _ in range(m)])

        def closed(pairs):
            at = {x: x for x in label.tolist()}
            for _ in range(m):
                for i, j in pairs:
                    a, b = at[label[i]], at[label[j]]
                    at = {k: min(a, b) if v in (a, b) else v for k, v in at.items()}
            return at

        allowed = lambda i, j: side[i] == 2 or side[i] != side[j]
        links = [(i, j) for i in range(m) for j in range(i) if allowed(i, j) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]
        got = neardup.merges(sets, label, side, 60)
        assert closed(got) == closed(links) and len(got) < len(set(label.tolist()))


# ---- Language model ----


def test_counts_and_base_score(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()] + [(None, "no id A a"), (10**9, None), (10**9, None)]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    words = lambda t: [*WORD.findall(lower(t)), None]
    count = {}
    for d, t in rows:
        if not held(d):
            for w in words(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, four = (sorted(maxent.score(df.repartition(p, F.xxhash64("text"))).collect(), key=lambda r: (str(r.doc_id), r.n_tokens)) for p in (1, 4))
    want = sorted(((str(d), len(words(t)), held(d), sum(w in count for w in words(t)), sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in words(t))) for d, t in rows))
    for r, (d, tokens, fold, known, base) in zip(one, want):
        assert (str(r.doc_id), r.n_tokens, r.held_out, r.n_known, r.train_tokens) == (d, tokens, fold, known, n)
        assert r.base_score == pytest.approx(base, abs=1e-6)
    # The model is a function of the rows, not of how they are dealt.
    for a, b in zip(one, four):
        assert a.score == pytest.approx(b.score, rel=1e-6)


def test_probabilities_sum_to_at_most_one(spark):
    rows = [(i, "a b c a b d a b") for i in range(30)] + [(50, "b c")]
    words = ["a", "b", "c", "d", "never"]
    ids = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 7 == 2]
    prefix = "a b "
    probes = list(zip(ids, [prefix + w for w in words]))
    got = {r.doc_id: r.score for r in maxent.score(spark.createDataFrame(rows + probes + [(ids[-1], prefix.strip())], "doc_id long, text string")).collect()}
    assert all(math.isfinite(x) and x < 0 for x in got.values())
    # P(prefix + w, end) summed over the words can't be over P(prefix): compare with the text that is the prefix alone, which also ends there.
    assert sum(10 ** got[i] for i, _ in probes) + 10 ** got[ids[-1]] <= 1.0


# ---- Byte-level BPE ----


def test_a_long_match_takes_linear_time():
    pairs, rng = bpe.load(), random.Random(1)
    took = []
    for n in (100_000, 800_000):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        start = time.process_time()
        ids = pairs.encode(text)
        took.append(time.process_time() - start)
        assert pairs.decode(ids) == text.encode()
    assert took[1] < 20 * took[0]


# ---- Toxicity ----


def test_nearest_like_full_cosine():
    rng = np.random.default_rng(3)
    for trial in range(12):
        vocabulary = np.sort(rng.choice(2**40, 60, replace=False).astype(np.uint64))
        idf = rng.random(60) ** (6 if trial % 2 else 1) + 0.01
        terms = [np.sort(rng.choice(vocabulary, rng.integers(1, 20), replace=False)) for _ in range(300)]
        counts = [rng.integers(1, 5, len(t)) for t in terms]
        index = toxicity.Index(list(range(0, 600, 2)), rng.integers(0, 2, 300), terms, counts, vocabulary, idf)

        def dense(t, n):
            out = np.zeros(60)
            out[np.searchsorted(vocabulary, t)] = (1 + np.log(n)) * idf[np.searchsorted(vocabulary, t)]
            return out / np.sqrt((out**2).sum())

        every = np.stack([dense(t, n) for t, n in zip(terms, counts)])
        for _ in range(15):
            t = np.sort(rng.choice(vocabulary, rng.integers(1, 25), replace=False))
            n = rng.integers(1, 5, len(t))
            cosine = every @ dense(t, n)
            best = [i for i in sorted(range(300), key=lambda i: (-round(cosine[i], 12), i)) if cosine[i] > 1e-15][: toxicity.NEAREST]
            at, score = index.nearest(*index.known(t, n))
            assert at.tolist() == best and np.allclose(score, cosine[best])


def test_toxicity_of_defined_cases(spark):
    texts = [(i, f"plain words number{i} of a calm text") for i in range(1, 60)] + [(i, f"you idiot number{i} of a calm text") for i in range(100, 130)]
    odd = [(1, "you idiot"), (1, "plain words"), (None, "you idiot scum"), (500, ""), (500, None), (501, "qqq zzz")]
    labels = [(i, 0, int(i >= 100)) for i, _ in texts] + [(None, 0, 1), (7, 0, None)]
    got = toxicity.score(spark.createDataFrame(texts + odd, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(texts) + len(odd)
    assert all(by[i][0].predicted == (i >= 100) for i, _ in texts if i != 1)
    assert len({r.score for r in by[500]}) == 1 and by[None][0].predicted == 1 and sorted(r.predicted for r in by[1]) == [0, 0, 1]
    assert by[501][0].evidence == [] and 0 <= by[501][0].score < 0.5


# ---- Tool calls ----

SCHEMA = {"add": {"a": ("integer", True, 0, 10), "b": ("number", False, None, None)}, "say": {"text": ("string", True, 1, 5), "loud": ("boolean", False, None, None), "to": ("array", False, None, None), "meta": ("object", False, None, None)}}


def test_calls(spark):
    call = lambda i, name, arguments, after=None, turn=0: (1, turn, i, name, arguments, after)
    calls = [
        call("ok", "add", '{"b": 1.5, "a": 3}'), call("next", "add", '{"a": 1}', "ok"), call("third", "say", '{"text":"hi","loud":true,"to":[1],"meta":{"z":1,"a":2}}', "next"),
        call("wrong", "add", '{"a": "3", "b": "x"}'), call("over", "add", '{"a": 11}'), call("long", "say", '{"text":"123456"}'), call("none", "say", "{}"), call("list", "add", "[1]"), call("broken", "add", "{"), call("null", "add", None),
        call("who", "fly", "{}"), call("lost", "add", '{"a":1}', "nowhere"), call("c1", "add", '{"a":1}', "c2"), call("c2", "add", '{"a":1}', "c1"), call("behind", "add", '{"a":1}', "c1"), call("self", "add", '{"a":1}', "self"),
        call("twice", "say", '{"text":"b"}', turn=2), call("twice", "say", '{"text":"a"}', turn=2), call("twice", "say", '{"text":"a"}', turn=2), call(None, "add", '{"a":1}'),
    ]
    results = [(1, 5, "ok", "3"), (1, 6, "ok", "3"), (1, 6, "ok", "3"), (1, 7, "gone", "x"), (1, 8, None, None), (1, 9, "third", 'q"'), (1, 9, "c1", "y")]
    got = tools.link(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after string"), spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), SCHEMA).collect()
    assert len(got) == len(calls) + len(results)
    made = {}
    for r in got:
        if r.kind == "call":
            made.setdefault(r.call_id, []).append((r.step, r.status, r.valid, r.errors))
    assert made["ok"] == [(0, "answered", True, "")] and made["next"] == [(2, "unanswered", True, "")] and made["third"] == [(4, "answered", True, "")]
    assert made["wrong"][0][3] == "a: not integer; b: not number" and made["over"][0][3] == "a: above 10" and made["long"][0][3] == "text: above 5" and made["none"][0][3] == "text: missing"
    assert {made[x][0][3] for x in ("list", "broken", "null")} == {"arguments: not an object"} and made["who"][0][3] == "name: unknown tool"
    assert made["lost"] == [(0, "unanswered", False, "after: unknown call")]
    assert {made[x][0][:2] for x in ("c1", "c2", "behind", "self")} == {(None, "cycle")}
    assert sorted(made["twice"], key=str) == [(0, "unanswered", True, ""), (None, "duplicate", True, ""), (None, "duplicate", True, "")] and made[None] == [(None, "unidentified", True, "")]
    texts = [json.loads(r.json) for r in got]
    assert all(json.dumps(t, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json for t, r in zip(texts, got))
    said = sorted((str(r.call_id), r.status, r.step) for r in got if r.kind == "result")
    assert said == sorted([("ok", "linked", 1)] * 3 + [("gone", "orphan", None), ("None", "orphan", None), ("third", "linked", 5), ("c1", "linked", None)])


def test_dialogues_like_sql_on_odd_rows(spark):
    import duckdb

    from bulletin.llm.sql import ORACLES

    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 0, "user", "other"), (1, 0, "system", "s"), (1, 1, "assistant", None), (1, 2, "user", ""), (1, 3, "assistant", "ok"), (1, 3, "assistant", "ok"), (2, 0, "assistant", "alone"), (None, 0, "user", "x"), (3, None, None, None), (4, 5, "user", "x" * 500), (4, 2000, "assistant", "late")]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = con.sql(ORACLES["op2_tool_call_linking"])
    got = tools.link_dialogues(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(repr(tuple(r[c] for c in sorted(got.columns))) for r in got.collect()) == sorted(repr(tuple(r[want.columns.index(c)] for c in sorted(want.columns))) for r in want.fetchall())


# ---- Search, shards, media ----


def test_top_k_of_odd_numbers(spark):
    big = float(2**40)
    rows = [(7, [big, -big]), (50, [0.25, 0.5]), (50, [-0.25, 0.5]), (1, [1.0, 1.0]), (2, [-big, big]), (3, [0.0, 0.0]), (4, [0.5, 0.5])]
    got = topk.embeddings_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3)
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for i, v in q:
        if i % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in q if j != i))[:3]
            if all(abs(s) < 2**63 for s, _ in best):
                want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    found = [tuple(r) for r in got.where("query_id = 50").collect()]
    assert sorted(found) == sorted(w for w in want if w[0] == 50) and len(found) == 6


def test_cut_edges_are_counted_and_few(spark):
    rows = [(i, i % 90) for i in range(900)] + [(i, 1000 + i) for i in range(900, 1000)]
    links = spark.createDataFrame(rows, "doc_id long, hub long")
    placed = sharding.propagate(links.select("doc_id"), links, 7)
    at = {r.doc_id: r.shard for r in placed.collect()}
    pairs = sum(a[1] == b[1] and at[a[0]] != at[b[0]] for a, b in itertools.combinations(rows, 2))
    assert sharding.cut_edges(placed, links).agg(F.sum("cut")).first()[0] == pairs
    scattered = sum(a[1] == b[1] and a[0] * 7919 % 7 != b[0] * 7919 % 7 for a, b in itertools.combinations(rows, 2))
    assert pairs <= 0.05 * scattered


def test_media_like_plain_bytes(spark):
    rows = [(1, "text"), (2, None), (3, ""), (4, "é" * 200), (5, "text"), (None, "text"), (6, "x" * 192)]
    got = media.media_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for d, t in rows:
        b = (t or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        stored = media.encoded(p)
        want.append((str(d), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), f"png 192x{len(p) // 192} 8 bit type 0"))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in got) == sorted(want)


# ---- The pipeline, stage by stage ----


def test_stages_by_value(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    folder = "/root/testdata/sf0.01"
    key = lambda rows: sorted((r.doc_id, r.text) for r in rows)

    clean = P.drop_toxic(spark, docs, folder)
    bad = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    every = docs.collect()
    assert clean.columns == docs.columns and key(clean.collect()) == key(r for r in every if r.doc_id not in bad) and bad

    one = P.drop_near_duplicates(spark, clean, folder)
    rows = sorted(clean.collect(), key=lambda r: r.doc_id)
    roots = groups([shingles(r.text, 5) for r in rows], 80)
    assert key(one.collect()) == key(r for i, r in enumerate(rows) if roots[i] == i or not shingles(r.text, 5))

    kept = P.drop_repeated_passages(spark, one, folder)
    first, want = {}, []
    for r in sorted(one.collect(), key=lambda r: r.doc_id):
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], r.doc_id) < r.doc_id:
                gone[i : i + 50] = b"\1" * 50
        want.append((r.doc_id, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted(want)

    mixed = P.mix_sources(spark, kept, folder).collect()
    size = lambda t: len(WORD.findall(t or ""))
    by_source, took = {}, {}
    for r in kept.collect():
        by_source[r.source] = by_source.get(r.source, 0) + size(r.text)
    for r in mixed:
        took[r.source] = took.get(r.source, 0) + size(r.text)
    sources = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, free, total = {}, set(sources), sum(by_source.values())
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * by_source[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3 * by_source[s] for s in over}
        free -= over
    largest = max(size(r.text) for r in kept.collect())
    assert all(target[s] - largest <= took.get(s, 0) <= target[s] for s in sources) and max(np.unique([r.doc_id for r in mixed], return_counts=True)[1]) <= 3

    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load().ranks, special_tokens={})
    frame = spark.createDataFrame([(r.doc_id, r.text) for r in mixed], "doc_id long, text string")
    ids = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.tokenise(spark, frame, folder).collect()}
    for r in mixed:
        tokens = library.encode_ordinary(r.text or "")
        assert ids[r.doc_id] == (len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, FOLDER)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_array_dedup", "mixing", "byte_bpe"]
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_copied_hashes_do_not_decide(monkeypatch):
    """Runs whose hashes agree but whose bytes differ are told apart: with a hash that sees nothing, the next one has to."""
    from bulletin.llm import bytesops as B

    monkeypatch.setattr(B, "range_hashes", lambda sums, a, b: np.zeros(len(a), np.uint64))
    rng = random.Random(6)
    text = lambda: "".join(rng.choice("abcd") for _ in range(300))
    t = [text() for _ in range(4)]
    table = pa.table({"doc_id": pa.array([1, 2, 3, 4]), "salt": pa.array([1, 2, 3, 4]), "text": pa.array([*t[:3], t[0][50:200] + t[3]])})
    block = substrings._Block(table, pa.table({"copies": pa.array([], pa.list_(pa.int64()))}))
    first, of = block.classes()
    strings = [block.data[a : b + substrings.LENGTH].tobytes() for a, b in zip(block.first, block.last)]
    assert all((strings[i] == strings[j]) == (of[i] == of[j]) or block.at[i] - block.first[i] != block.at[j] - block.first[j] for i in range(0, len(of), 3) for j in range(0, len(of), 5))
