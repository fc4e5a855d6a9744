"""Operators against plain versions: bootstrap, budgets, caches, the seam, readers and the sink, reports of any pipeline."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from bulletin.operators import ledger, rank, report
from bulletin.plans import report_queries, seam
from bulletin.sources import files
from bulletin.sources.postings import postings

FOLDER = "/root/testdata/sf0.001"


def plain_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_bootstrap_like_loops(spark):
    base = [(p, i, (i * 7 + p) % 5 / 5, (i * 3 + p) % 7 / 7, (i + p) % 3 == 0) for p in range(3) for i in range(12)]
    samples = 230
    diffs = []
    for r in range(samples):
        times = rank.drawn(r, 12, 0)
        means = []
        for which in (2, 3):
            each = [plain_auc([(x[which], x[4]) for x in base if x[0] == p for _ in range(times[x[1]])]) for p in range(3)]
            means.append(sum(a for a in each if a is not None) / sum(a is not None for a in each))
        diffs.append(means[1] - means[0])
    diffs.sort()
    df = spark.createDataFrame(base, "profile int, item int, a double, b double, label boolean")
    got = rank.bootstrap_auc_difference(df, samples=samples, block=100).first()
    assert got.n == samples and math.isclose(got.low, diffs[int(0.025 * samples)]) and math.isclose(got.high, diffs[math.ceil(0.975 * samples) - 1])
    assert rank.bootstrap_auc_difference(df.limit(0)).first().n == 0


def test_budgets_like_a_loop(spark):
    calls = [(i % 3 if i % 11 else None, f"2026-0{1 + i % 2}-{1 + i // 9:02d} 10:00:{i % 60:02d}", i, float(i * 37 % 23), float(i * 37 % 23) * 0.8 - 2) for i in range(200)]
    df = spark.createDataFrame(calls, "who int, at string, n int, estimate double, cost double").withColumn("at", F.col("at").cast("timestamp"))
    want = {}
    for who, at, n, estimate, cost in sorted(calls, key=lambda c: (c[1], c[2])):
        s = want.setdefault(who, {"day": None, "month": None, "d": 0.0, "m": 0.0, "yes": 0, "no": 0, "all": 0.0})
        day, month = at[:10], at[:7]
        s["d"], s["m"] = (s["d"] if s["day"] == day else 0.0), (s["m"] if s["month"] == month else 0.0)
        ok = s["d"] + estimate <= 40 and s["m"] + estimate <= 300
        more = max(cost, 0.0) if ok else 0.0
        s.update(day=day, month=month, d=s["d"] + more, m=s["m"] + more, yes=s["yes"] + ok, no=s["no"] + (not ok), all=s["all"] + more)
    got = ledger.admitted(df, ["who"], ["at", "n"], "estimate", "cost", 40.0, 300.0).collect()
    assert {r.who: (r.admitted, r.rejected, r.month, round(r.spent, 4)) for r in got} == {k: (s["yes"], s["no"], s["month"], round(s["all"], 4)) for k, s in want.items()}


def test_cache_modes(spark):
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "key string")
    cache = spark.createDataFrame([("a", "old"), ("z", "old")], "key string, answer string")
    fresh = lambda df: df.select("key", F.concat(F.lit("new "), "key").alias("answer"))
    answers = lambda mode, who=asked: sorted((r.key, r.answer) for r in ledger.cached(who, cache, mode, fresh).collect())
    assert answers("off") == [("a", "new a"), ("a", "new a"), ("b", "new b"), ("c", "new c")]
    assert answers("record") == [("a", "old"), ("a", "old"), ("b", "new b"), ("c", "new c")]
    assert answers("replay", asked.where("key = 'a'")) == [("a", "old"), ("a", "old")]
    with pytest.raises(Exception, match="not in the replay cache"):
        answers("replay")
    with pytest.raises(ValueError):
        answers("other")


def test_seam(spark):
    class Busy:
        def __init__(self):
            self.n = 0

        def embed(self, text):
            self.n += 1
            if self.n < 3:
                raise seam.RateLimited if self.n == 1 else seam.Transient
            return [float(len(text))]

    texts = spark.createDataFrame([("abc",)], "text string")
    assert [tuple(r) for r in seam.embedded(texts, Busy, pause_s=0.0).collect()] == [("abc", [3.0])]
    asked = spark.createDataFrame([("1", "s", "x [stub:rate_limited]"), ("2", "s", "x [stub:transient]"), ("3", "s", "x [stub:broken]"), ("4", "s", "one two")], "key string, system string, user string")
    got = {r.key: (r.code, r.calls, r.answer is not None) for r in seam.outcomes(asked, seam.StubProvider).collect()}
    assert got == {"1": ("RATE_LIMITED", 1, False), "2": (None, 2, True), "3": ("SCHEMA", 2, False), "4": (None, 1, True)}


def test_field_similarity_like_loops(spark):
    rows = [(1, "채용 개발", ["백엔드", "서버"]), (2, "", []), (3, "AUTOMOBILE 안내", ["x"])]
    profile = "AUTOMOBILE, 채용 개발"

    def embed(text):
        v = [0.0] * 16
        for a, b in zip(text, text[1:]):
            v[hashlib.md5((a + b).encode()).digest()[0] % 16] += 1.0
        return v

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    want = {}
    for i, title, words in rows:
        text = f"{title.strip()}\n{', '.join(words)}".strip()
        want[i] = (round(cosine(embed(text), embed(profile)), 4), None) if text else (None, 0)
    df = spark.createDataFrame(rows, "id int, title string, keywords array<string>")
    got = {r.id: r for r in seam.field_similarity(df, F.lit(profile)).collect()}
    for i, (similarity, score) in want.items():
        assert got[i].similarity == (None if similarity is None else pytest.approx(similarity, abs=1e-4))
        expected = 0 if similarity is None else max(0, min(100, math.floor((similarity - 0.365) / (0.509 - 0.365) * 100 + 0.5)))
        assert abs(got[i].score - expected) <= 1 and (score is None or got[i].score == score)


def test_readers_and_sink(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "001-a.md").write_text("---\ntitle: 'One'\ntags: [x, y]\n---\nBody one\n")
    (tmp_path / "p" / "README.md").write_text("no")
    (tmp_path / "p" / "000-example.md").write_text("---\nid: 0\n---\nexample")
    (tmp_path / "p" / "002-b.md").write_text("plain")
    posts = files.read_postings(spark, str(tmp_path / "p"))
    assert [(r.stem, r.body, r.head.get("tags")) for r in posts.collect()] == [("001-a", "Body one", ["x", "y"]), ("002-b", "plain", None)]
    assert files.read_postings(spark, str(tmp_path / "p"), skip_example=False).count() == 3
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "001-a.json").write_text(json.dumps({"dueDate": "2026-05-01", "keywords": ["k"]}))
    labels = files.read_labels(spark, str(tmp_path / "l"), "dueDate string, keywords array<string>")
    assert [(r.stem, r.dueDate) for r in files.with_labels(posts, labels).orderBy("stem").collect()] == [("001-a", "2026-05-01"), ("002-b", None)]
    (tmp_path / "profiles.json").write_text(json.dumps({"profiles": [{"id": "u", "jobCodes": ["A"], "tags": ["t"], "relevant": {"p1": 2}}, {"id": "v", "jobCodes": [], "tags": [], "relevant": {}}]}))
    assert sorted((r.id, r.posting_id, r.grade) for r in files.read_profiles(spark, str(tmp_path / "profiles.json")).collect()) == [("u", "p1", 2), ("v", None, None)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text(json.dumps({"id": "d1", "request": {"question": "q", "maxChars": 500, "keywords": ["k"]}, "forbidden": ["no"], "emphasis": True}))
    (tmp_path / "d" / "b.json").write_text(json.dumps({"request": {"question": "q2"}}))
    drafts = files.read_draft_cases(spark, str(tmp_path / "d")).collect()
    assert [(r.id, r.note, r.forbidden, r.emphasis, r.request.maxChars) for r in drafts] == [("d1", "", ["no"], True, 500), ("b", "", [], False, None)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.json").write_text(json.dumps({"note": "n", "request": {"matchedKeywords": ["a"], "missingQualifications": ["b"], "topExperienceTitle": "t"}, "expect": {"strength": True}}))
    (tmp_path / "c" / "y.json").write_text(json.dumps({"request": {"topExperienceTitle": ""}}))
    comments = files.read_comment_cases(spark, str(tmp_path / "c")).collect()
    assert [(r.id, r.note, r.grounds, r.expect, r.forbidden) for r in comments] == [("x", "n", ["a", "b", "t"], {"strength": True}, []), ("y", "", [], {}, [])]
    files.write_report(spark.createDataFrame([(1, "x")], "n int, s string"), str(tmp_path / "out"), "r1")
    files.write_report(spark.createDataFrame([(2, "y")], "n int, s string"), str(tmp_path / "out"), "r2")
    assert sorted((r.n, r.run_id) for r in spark.read.json(str(tmp_path / "out")).collect()) == [(1, "r1"), (2, "r2")]


def test_any_pipeline_can_be_evaluated(spark):
    p = report_queries.labelled(postings(spark, FOLDER))
    perfect = lambda df: df.withColumns({
        "due_date": F.col("want_due"), "kind": F.col("want_kind"), "n_questions": F.col("want_questions"), "year": F.element_at("want_year", 1), "gpa": F.element_at("want_gpa", 1), "major": F.lit(None).cast("string"),
        "keywords": F.col("gold"), "preferences": F.col("gold_preferences"), "likely": F.col("reason").isNull(),
    })
    rows, figures = report.evaluated(p, perfect)
    r = figures.first()
    assert rows.count() == p.count() == r.n
    assert [r.due_accuracy, r.type_accuracy, r.question_accuracy, r.posting_accuracy, r.qualification_accuracy, r.keyword_recall, r.keyword_precision, r.preference_recall, r.preference_precision] == [1.0] * 9
    assert (r.hallucinated, r.qualification_hallucinated, r.keyword_forbidden) == (0, 0, 0)
    empty = report.evaluated(p.limit(0), perfect)[1].first()
    assert empty.n == 0 and empty.due_accuracy is None


def test_prompts_are_pinned(spark):
    names = [("p/parse.v1.md", "one"), ("p/parse.v2.md", "two"), ("p/parse.v10.md", "ten"), ("p/draft.v1.md", "d"), ("p/README.md", "no")]
    table = spark.createDataFrame(names, "path string, text string")
    assert sorted((r["name"], r.version, r.text) for r in files.prompt_versions(table).collect()) == [("draft", 1, "d"), ("parse", 10, "ten")]
    assert sorted((r["name"], r.version, r.text) for r in files.prompt_versions(table, {"parse": "v1"}).collect()) == [("draft", 1, "d"), ("parse", 1, "one")]
