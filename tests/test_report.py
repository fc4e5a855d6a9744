import itertools
import random
import re

from pyspark.sql import functions as F

from bulletin.functions import guard as G
from bulletin.functions import patterns as P
from bulletin.functions import text as T
from bulletin.operators import report as R


def test_repeated_answers_are_measured_once(spark):
    rows = spark.createDataFrame([(1, "x", ["s"]), (2, "x", ["s"]), (3, None, ["s"]), (4, None, ["s"]), (5, "y", None)], "id int, answer string, sources array<string>")
    seen = []

    def measure(keys):
        seen.extend(keys.collect())
        return keys.withColumn("n", F.coalesce(F.length("answer"), F.lit(-1)))

    assert sorted((r.id, r.n) for r in R.once(rows, ("answer", "sources"), measure).collect()) == [(1, 1), (2, 1), (3, -1), (4, -1), (5, 1)]
    assert len(seen) == 3


def _grams(t):
    return {t[i : i + 3] for i in range(len(t) - 2)}


def _mean(texts):
    near = [len(_grams(a) & _grams(b)) / len(_grams(a) | _grams(b)) if _grams(a) | _grams(b) else 1.0 for a, b in itertools.combinations(texts, 2)]
    return sum(near) / len(near)


def test_cross_similarity_equals_all_pairs(spark, monkeypatch):
    deal = random.Random(7)
    text = lambda: "".join(deal.choice("가나다a😀") for _ in range(deal.choice((0, 1, 2, 3, 5, 30))))
    runs = {r: [text() for _ in range(n)] for r, n in enumerate((1, 2, 5, 40))}
    rows = spark.createDataFrame([(r, t) for r, ts in runs.items() for t in ts], "run int, a string")
    got = {x.run: round(x.m, 9) for x in R.cross_similarity(rows, "run", "a", "m").collect()}
    assert got == {r: round(_mean(ts), 9) for r, ts in runs.items() if len(ts) > 1}
    monkeypatch.setattr(R, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(R, "BLOCK_GRAMS", 20)
    assert all(round(R._pairs_mean(ts), 9) == got[r] for r, ts in runs.items() if len(ts) > 1)


def test_pairs_are_no_rows(spark):
    """Of 300 answers in one run, no 44,850 pairs: the report joins no case with another."""
    spark = spark.newSession()
    rows = [(0, i, "first", "formal", f"답변 {i % 7}번입니다.", 0, ["s"], ["w"], False, 1, 0.5, ["m"]) for i in range(300)]
    answers = spark.createDataFrame(rows, "run long, id long, slot string, tone string, answer string, limit int, sources array<string>, forbidden array<string>, fallback boolean, tokens long, cost double, marks array<string>")
    report = R.draft_report(R.draft_measures(answers), ("formal", "casual"))
    assert not re.search(r"i#\d+L? < j#\d+|<.*\(x#", report._jdf.queryExecution().optimizedPlan().toString())
    assert "MapInArrow" in report._jdf.queryExecution().optimizedPlan().toString()
    got = report.first()
    assert (got.calls, got.total_tokens, got.distinguishable_of) == (300, 300, 0)
    assert abs(got.cross_case_ngram_mean - _mean([f"답변{i % 7}번입니다." for i in range(300)])) < 1e-9


def test_spellings_in_their_order(spark):
    order = [*P.NOT_SPELLINGS, *sorted(P.SPELLINGS, key=lambda k: -len(k))]
    deal = random.Random(3)
    texts = ["스프링클러 스프링", "스프링부트", "자바스크립트자바", "리눅스프링", "쿠버네티스프링부트", "", *["".join(deal.choice(order)[deal.choice((0, 0, 1)) :] for _ in range(4)) for _ in range(200)]]
    hays = ["", "spring", "자바k8s"]

    def plain(c, hay):
        out = []
        for k in order:
            if k in P.SPELLINGS and k in c and k not in hay and not any(v in hay for v in P.SPELLINGS[k]):
                out.append(k)
            c = c.replace(k, " ")
        return out

    rows = spark.createDataFrame([(c, h) for c in texts for h in hays], "c string, h string").withColumn("got", G.spellings(F.col("c"), F.col("h")))
    assert all(r.got == plain(r.c, r.h) for r in rows.collect())


def test_white_is_what_the_pattern_says(spark):
    letters = spark.range(0xD800).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'utf-32')").alias("c")).union(spark.range(0xE000, 0x10000).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'utf-32')").alias("c"))).where("length(c) = 1")
    hits = letters.where(F.col("c").rlike(P.U(r"\A\s\z"))).collect()
    assert sorted(r.c for r in hits) == sorted(P.WHITE)
    x = letters.select(T.strip(F.concat("c", F.lit("x"), "c")).alias("got"), "c")
    assert x.where((F.col("got") == "x") != F.col("c").rlike(P.U(r"\A\s\z"))).count() == 0
