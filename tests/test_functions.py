import datetime
import re

from pyspark.sql import functions as F

from bulletin.functions import extract as E
from bulletin.functions import guard as G
from bulletin.functions import patterns as P
from bulletin.functions import text as T
from bulletin.sources.postings import postings

FOLDER = "/root/testdata/sf0.001"


def one(spark, make, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def due(spark, text, as_of="2026-05-01"):
    df = spark.createDataFrame([(text, datetime.date.fromisoformat(as_of))], "t string, d date").withColumn("h", E.due_candidates(F.col("t"), F.col("d")))
    return df.select(E.due_date(F.col("h"), F.col("t")).alias("x")).first()["x"]


def test_deadlines(spark):
    assert str(due(spark, "접수기간: 2026. 5. 2. ~ 2026. 6. 10. 18:00").iso) == "2026-06-10"
    assert due(spark, "제출기한 26.06.01 18시").has_time
    assert due(spark, "신청기간: 6월 3일").year_inferred
    assert due(spark, "상시 모집").reason == "no_deadline"
    assert due(spark, "마감일은 2099년 12월 31일").reason == "not_found"
    assert due(spark, "모집 인원의 1.2~1.3배수").iso is None
    assert str(due(spark, "1차 접수: 2026.05.10 안내. 2차 접수: 2026.06.20").iso) == "2026-06-20"
    assert str(due(spark, "마감일\n\n2026.06.21\n\n기타").iso) == "2026-06-21"


def test_limits_and_questions(spark):
    assert one(spark, E.max_chars, "50자 이상 400자 이내") == 400
    assert one(spark, E.max_chars, "800자") == 800
    found = one(spark, E.form_questions, "1. 지원 동기를 작성해 주세요 (500자 이내)\n2. 계좌번호를 적어 주세요\n- 메일로 문의해 주세요")
    assert [(q.order, q.max_chars) for q in found] == [(1, 500)]


def test_normalize(spark):
    pairs = [
        ("a\r\nb\rc", "a\nb\nc"), ("x \t\u00a0 y", "x y"), ("one   \ntwo", "one\ntwo"), ("a\n\n\n\n\nb", "a\n\nb"), ("a\n\nb", "a\n\nb"), ("\x00a\x07b\x7f", "ab"),
        ("\u3000가\u3000나 ", "가 나"), ("", ""), (" \n \n ", ""), ("\n\nfirst\n \n \nlast\t\n", "first\n\nlast"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", T.normalize(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(pairs))] == [want for _, want in pairs]


def test_resegment_like_another_engine(spark):
    p = postings(spark, FOLDER).select("k", F.regexp_replace("body", r"\s+", " ").alias("t"))
    rows = p.select("k", "t", T.resegment(F.col("t")).alias("x"), T.is_flat(F.col("t")).alias("flat")).collect()
    assert rows and all(r.flat and r.x == re.sub(P.SEGMENT_BEFORE, "\n", r.t) for r in rows)
    assert not one(spark, T.is_flat, "a\nb\nc")


def test_stems_are_in_every_hit(spark):
    assert T.stems("ab?c|de") == ("a", "de") and T.stems(r"a|\d") == () and T.stems("(?:ab|cd)e|(?<!x)f") == ("ab", "cd", "f") and T.stems("(?:a)?b") == ()
    texts = [r.body for r in postings(spark, FOLDER).select("body").limit(200).collect()] + [r.story for r in postings(spark, FOLDER).select("story").limit(200).collect()]
    patterns = [P.QUAL_HEADING, P.MAJOR_ANY, P.MAJOR_FREE, P.APPLICABLE, P.ELIGIBILITY, *P.GPA, *P.TYPE_HINTS.values(), *P.DISCRIMINATORY.values()]
    for p in patterns:
        words = T.stems(p)
        assert all(not re.search(p, t) or not words or any(w in t for w in words) for t in texts)


def test_contacts_near_hangul(spark):
    assert one(spark, lambda c: T.mask_contacts(c)[0], "문의 abc@x.com 010-1234-5678") == "문의 [이메일] [연락처]"
    assert one(spark, lambda c: T.mask_contacts(c)[1], "전화02-123-4567입니다") == 0


def test_guards(spark):
    assert one(spark, lambda a, b: G.fact_check(a, F.array(b)), "매출 30% 증가, 도커", "docker") == ["30%"]
    assert one(spark, E.discriminatory, "용모 단정한 분") == ["신체조건"]
    assert one(spark, G.past, "했다") and not one(spark, G.past, "있겠다")
    assert one(spark, G.extract_json, "x {\"b\": 1, \"a\": 2} y") == '{"a":2,"b":1}'
    assert one(spark, G.extract_json, "[1]") is None
