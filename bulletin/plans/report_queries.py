"""Queries of the reports on generated texts and on pipelines, and of the seam's error handling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import patterns as P
from ..functions import text as T
from ..operators import report as R
from .guard_queries import KEY, _any_cited, _claimed, _facts, _tokens
from .registry import query
from .rule_queries import GRADES, due
from .text_queries import GRAMS, SENTENCES

#: Cases of one run.
RUN = 16

# ---- Drafts ----

CASUAL = "replace(replace(story, '다.', '요.'), '죠!', '요.')"
AGAIN = "case k % 3 when 0 then story when 1 then source || '다. ' || story else source || '다.' end"
TURNED = "case when k % 4 = 0 then ground2 || ' ' || story end"


def _ending(c: str, tone: str) -> str:
    trailing = P.TRAILING.replace("'", "''")
    return f"len(list_filter({SENTENCES.format(c)}, lambda z: regexp_matches(regexp_replace(z, '{trailing}', ''), '{P.ENDINGS[tone]}'))) / nullif(len({SENTENCES.format(c)}), 0)"


def _phrases(c: str, phrases: tuple[str, ...]) -> str:
    return " + ".join(f"(length({c}) - length(replace({c}, '{p.replace(' ', '')}', ''))) // {len(p.replace(' ', ''))}" for p in phrases)


def _near(x: str, y: str) -> str:
    return f"case when len({x}) + len({y}) = 0 then 1.0 else len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) end"


def _marks(a: str, b: str) -> str:
    words = lambda c: f"list_distinct(list_transform(regexp_extract_all({c}, '{P.TOKEN}'), lambda x: {KEY.format('x')}))"
    return f"list_filter({words(a)}, lambda y: not list_contains({words(b)}, y))"


def _sentence_keys(c: str) -> str:
    trailing = P.TRAILING.replace("'", "''")
    return f"list_transform({SENTENCES.format(c)}, lambda z: {KEY.format(f'''regexp_replace(z, '{trailing}', '')''')})"


DRAFTS = f"""with r as (select (k // {RUN})::bigint as run, k as id, source, ground, ground2, word, k % 10 = 0 as fallback, case when k % 13 > 0 then 100 + k % 50 end as tokens, case when k % 13 > 0 then (k % 97) / 1000.0::double end as cost,
  case k % 4 when 0 then 0 when 1 then 50 when 2 then 100 else 25 end as lim, unnest(['first', 'first', 'regen', 'rotated']) as slot, unnest(['formal', 'casual', 'formal', 'formal']) as tone, unnest([story, {CASUAL}, {AGAIN}, {TURNED}]) as answer from p),
q as (select *, length(answer) as n, {KEY.format('source')} as hay, replace(answer, ' ', '') as compact from r where answer is not null),
m as (select *, case when lim > 0 then case when n > lim then 'over' when n < lim * (2.0::double / 3) then 'under' else 'ok' end when n < 400 then 'short' when n > 600 then 'long' else 'ok' end as length_grade,
  case when lim > 0 then round(n / lim, 2) end as fill_ratio, len(list_filter([ground, word], lambda w: w <> '' and contains({KEY.format('answer')}, {KEY.format('w')}))) as n_forbidden,
  len(list_distinct(list_concat({_facts('answer', 'hay')}, {_claimed('answer', 'source')}))) as n_unverified, case when tone = 'casual' then {_ending('answer', 'casual')} else {_ending('answer', 'formal')} end as ending_ratio,
  {_phrases('compact', P.HEDGES)} as hedges, {_phrases('compact', P.CLICHES)} as cliches, slot <> 'rotated' as own from q),
a as (select run, count(tokens) as calls, avg(case when own and lim > 0 then (length_grade <> 'over')::int end) as length_compliance, avg(case when own and lim > 0 then (length_grade = 'ok')::int end) as fill_compliance,
  avg(case when own then fill_ratio end) as fill_ratio_mean, avg(case when own and lim = 0 then (length_grade = 'ok')::int end) as default_range_compliance, avg(case when own then fallback::int end) as fallback_rate,
  sum(case when own then n_forbidden end)::bigint as forbidden_total, sum(case when own then n_unverified end)::bigint as unverified_total, avg(case when own and tone = 'formal' then ending_ratio end) as tone_consistency_formal,
  avg(case when own and tone = 'casual' then ending_ratio end) as tone_consistency_casual, sum(case when own then hedges end)::bigint as hedges, sum(case when own then cliches end)::bigint as cliches, sum(tokens)::bigint as total_tokens, round(sum(cost), 4) as cost_krw from m group by run),
c as (select run, id, any_value(ground) as ground, any_value(ground2) as ground2, max(case when slot = 'first' and tone = 'formal' then answer end) as a, max(case when slot = 'first' and tone = 'casual' then answer end) as b,
  max(case when slot = 'first' and tone = 'formal' then ending_ratio end) as ra, max(case when slot = 'first' and tone = 'casual' then ending_ratio end) as rb, max(case when slot = 'regen' then answer end) as again,
  bool_or(fallback) as ruled, max(case when slot = 'rotated' then answer end) as rotated from m group by run, id),
d as (select *, {GRAMS.format('a')} as ga, {GRAMS.format('again')} as gagain, {_tokens('a')} as fa, {_tokens('b')} as fb, {_sentence_keys('a')} as sa, {_sentence_keys('again')} as sagain, {_marks('ground', 'ground2')} as marks, {_marks('ground2', 'ground')} as turned,
  {KEY.format('a')} as ka, {KEY.format('rotated')} as kr from c),
e as (select *, {_near('fa', 'fb')} as facts, case when not ruled then {_near('ga', 'gagain')} end as alike, case when not ruled then case when len(sagain) = 0 then 0.0 else len(list_filter(sagain, lambda z: list_contains(sa, z))) / len(sagain) end end as copied from d),
g as (select run, count(*) filter (coalesce(ra, 0) >= 0.8 and coalesce(rb, 0) >= 0.8) as distinguishable, count(*) as distinguishable_of, avg(facts) as fact_jaccard_mean, avg(alike) as regen_ngram_mean, count(*) filter (alike >= 0.5) as regen_similar,
  avg(copied) as regen_sentence_mean, count(*) filter (rotated is not null and len(list_filter(marks, lambda w: contains(ka, w))) > 0 and len(list_filter(turned, lambda w: contains(kr, w))) > 0) as emphasis_follows, count(rotated) as emphasis_of from e group by run),
h as (select x.run, avg({_near('x.ga', 'y.ga')}) as cross_case_ngram_mean from d x join d y on x.run = y.run and x.id < y.id group by x.run)
select run, calls, round(length_compliance, 9) as length_compliance, round(fill_compliance, 9) as fill_compliance, round(fill_ratio_mean, 9) as fill_ratio_mean, round(default_range_compliance, 9) as default_range_compliance, round(fallback_rate, 9) as fallback_rate,
  forbidden_total, unverified_total, round(tone_consistency_formal, 9) as tone_consistency_formal, round(tone_consistency_casual, 9) as tone_consistency_casual, hedges, cliches, total_tokens, cost_krw, distinguishable, distinguishable_of, round(fact_jaccard_mean, 9) as fact_jaccard_mean,
  round(regen_ngram_mean, 9) as regen_ngram_mean, regen_similar, round(regen_sentence_mean, 9) as regen_sentence_mean, emphasis_follows, emphasis_of, round(cross_case_ngram_mean, 9) as cross_case_ngram_mean from a join g using (run) left join h using (run)"""


def _rounded(df: DataFrame) -> DataFrame:
    """Shares to nine places."""
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" and c != "cost_krw" else F.col(c) for c, kind in df.dtypes])


def draft_answers(t) -> DataFrame:
    """Every announcement's story as the answers of one case, in runs of RUN cases."""
    one = lambda slot, tone, answer, marks: F.struct(F.lit(slot).alias("slot"), F.lit(tone).alias("tone"), F.expr(answer).alias("answer"), marks.alias("marks"))
    words = lambda c: F.array_distinct(F.transform(T.found_all(F.col(c), P.TOKEN), T.norm_key))
    first, second = F.col("first"), F.col("second")
    slots = F.array(one("first", "formal", "story", first), one("first", "casual", CASUAL, first), one("regen", "formal", AGAIN, first), one("rotated", "formal", TURNED, second))
    called = F.col("k") % 13 > 0
    p = t.postings().withColumns({"first": words("ground"), "second": words("ground2")}).withColumns({"first": F.array_except(first, second), "second": F.array_except(second, first)})
    rows = p.select(
        F.expr(f"k div {RUN}").alias("run"), F.col("k").alias("id"), F.array("source").alias("sources"), F.array("ground", "word").alias("forbidden"), (F.col("k") % 10 == 0).alias("fallback"),
        F.when(called, 100 + F.col("k") % 50).alias("tokens"), F.when(called, (F.col("k") % 97) / 1000.0).alias("cost"), F.expr("case k % 4 when 0 then 0 when 1 then 50 when 2 then 100 else 25 end").alias("limit"), F.explode(slots).alias("x"),
    )
    return rows.select("*", "x.*").drop("x").where("answer is not null")


@query("agg_draft_report", DRAFTS, view=True)
def _(t):
    return _rounded(R.draft_report(R.draft_measures(draft_answers(t)), ("formal", "casual")))


# ---- Comments ----

STRENGTH, WEAKNESS = "case when k % 3 <> 0 then story end", "case when k % 4 = 0 then source || '다. ' || story end"
WANTED = {"expect_strength": "case when k % 5 < 3 then k % 2 = 0 end", "expect_weakness": "case when k % 7 < 3 then k % 2 = 1 end", "no_call": "k % 9 = 0"}
USED = {"tokens": "case when k % 11 = 0 then null when k % 6 = 0 then 0 else 50 + k % 20 end", "cost": "case when k % 11 > 0 then (k % 97) / cast(1000 as double) end"}
PII = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+|\b0\d{1,2}[-.)]\s?\d{3,4}[-.]\d{4}\b|\b01[016-9][-.]?\d{3,4}[-.]?\d{4}\b|\b\d{6}[-\s]?[1-4]\d{6}\b"


@query(
    "agg_comment_report",
    f"""with r as (select (k // {RUN})::bigint as run, word, ground, ground2, {STRENGTH} as s, {WEAKNESS} as w, {', '.join(f'{e} as {c}' for c, e in (WANTED | USED).items())} from p),
q as (select *, array_to_string(list_filter([s, w], lambda x: coalesce(x, '') <> ''), chr(10)) as text, {KEY.format("(ground || ' ' || ground2)")} as hay from r),
m as (select *, (case when s is null then 0 else 1 end) + (case when w is null then 0 else 1 end) as lines, coalesce(len({SENTENCES.format('s')}) > 2, false) or coalesce(len({SENTENCES.format('w')}) > 2, false) as over,
  len(list_filter([word, ground], lambda x: x <> '' and contains({KEY.format('text')}, {KEY.format('x')}))) as n_forbidden, case when text <> '' then len(list_distinct({_facts('text', 'hay')})) else 0 end as n_unverified,
  case when text <> '' then len(list_filter({SENTENCES.format('text')}, lambda z: not {_any_cited('z')})) = 0 end as grounded, regexp_matches(text, '{PII}') as pii,
  coalesce(expect_strength <> (s is not null), false) or coalesce(expect_weakness <> (w is not null), false) or (no_call and coalesce(tokens, 0) > 0) as missed from q)
select run, count(*) filter (not missed) as expect_ok, count(*) as expect_of, sum(n_forbidden)::bigint as forbidden_total, sum(n_unverified)::bigint as unverified_total, round(avg(grounded::int), 9) as grounded_rate, count(*) filter (lines > 3 or over) as format_violations,
  count(*) filter (pii) as pii_total, round(avg(case when coalesce(tokens, 0) > 0 then (s is null and w is null)::int end), 9) as silent_rate, coalesce(sum(tokens), 0)::bigint as total_tokens, coalesce(round(sum(cost), 4), 0) as cost_krw from m group by run""",
    view=True,
)
def _(t):
    cols = {c: F.expr(e) for c, e in (WANTED | USED).items()}
    cases = t.postings().select(F.expr(f"k div {RUN}").alias("run"), F.col("k").alias("id"), F.expr(STRENGTH).alias("strength"), F.expr(WEAKNESS).alias("weakness"), F.array("ground", "ground2").alias("grounds"), F.array("word", "ground").alias("forbidden"), *[e.alias(c) for c, e in cols.items()])
    return _rounded(R.comment_report(R.comment_measures(cases)))


# ---- Pipelines ----


def labelled(p: DataFrame) -> DataFrame:
    """Announcements with the labels that their columns give, some failed, some without a deadline's label."""
    c = F.col
    return p.withColumns({
        "failed": c("k") % 29 == 0, "want_present": c("k") % 31 != 0, "reason": F.when(c("k") % 23 == 0, "NOT_A_POSTING"), "want_due": F.when(c("style") != 5, c("e")), "want_kind": c("kind"), "want_questions": F.lit(2),
        "want_year": T.texts("2 학년", "없음"), "want_gpa": T.texts("평점 3.5 이상"), "want_major": F.lit(None).cast("array<string>"), "gold": F.array("word", F.lit("없는 말")), "gold_not": F.array(F.lower("seg")),
        "gold_preferences": F.when(c("k") % 5 > 0, T.texts("활동 경험 1회", "관련  활동 경험 2 회")),
    })


def by_rules(p: DataFrame) -> DataFrame:
    """The record that the rules make, as columns; keywords are what a model would add."""
    r = due(p).withColumn("_lines", E.qualification_lines(F.col("body"))).withColumn("_q", E.qualifications(F.col("_lines")))
    likely = E.signals(F.col("body"), F.col("due.iso").isNotNull() | (F.col("due.reason") == "no_deadline"), F.col("title"))["likely_posting"]
    return r.withColumns({
        "due_date": F.col("due.iso"), "kind": E.guess_type(F.col("title"), F.col("body")), "n_questions": F.size(E.form_questions(F.col("body"))), "year": F.col("_q.year"), "gpa": F.col("_q.gpa"), "major": F.col("_q.major"),
        "keywords": F.array("word", "seg"), "preferences": E.preferences(F.col("body")), "likely": likely,
    })


@query(
    "eval_report",
    f"""with g as ({GRADES}), f as (select k, k % 29 = 0 as failed, prefs, k % 5 > 0 as preferred, case when k % 29 = 0 then null when grade = 2 then 'correct' else 'wrong' end as year,
  case when k % 29 = 0 then null when k % 2 = 0 then case when k % 9 = 5 then 'correct' else 'wrong' end else 'missed' end as gpa, case when k % 29 = 0 then null when k % 3 = 0 then 'hallucinated' else 'correct_null' end as major from p),
q as (select unnest([year, gpa, major]) as grade from f), rate as (select count(*) filter (grade in ('correct', 'correct_null')) / count(grade) as quality, count(*) filter (grade = 'hallucinated') as made_up from q)
select count(*) as n, count(*) filter (due in ('correct', 'correct_null')) / count(*) filter (due <> 'skip') as due_accuracy, count(*) filter (type = 'correct') / count(*) filter (type <> 'skip') as type_accuracy,
  count(*) filter (questions = 'correct') / count(*) filter (questions <> 'skip') as question_accuracy, count(*) filter (posting = 'correct') / count(*) filter (posting <> 'skip') as posting_accuracy,
  (select quality from rate) as qualification_accuracy, (select made_up from rate) as qualification_hallucinated, count(*) filter (due = 'hallucinated') as hallucinated,
  sum(case when not failed then 1 end) / sum(case when not failed then 2 end) as keyword_recall, sum(case when not failed then 1 end) / sum(case when not failed then 2 end) as keyword_precision, sum(case when not failed then 1 end)::bigint as keyword_forbidden,
  sum(case when not failed and preferred then prefs end) / sum(case when not failed and preferred then 2 end) as preference_recall, sum(case when not failed and preferred then prefs end) / nullif(sum(case when not failed and preferred then prefs end), 0) as preference_precision
from g join f using (k)""",
    view=True,
)
def _(t):
    return R.evaluated(labelled(t.postings()), by_rules)[1]


@query(
    "run_answers",
    f"""with r as (select word as path, k as id, unnest([0, 1, 1000, 1001]) as place, unnest(['formal', 'casual', 'regen', 'emphasis']) as slot, unnest([story, {CASUAL}, {AGAIN}, {TURNED}]) as answer from p)
select path, id, slot, answer from r where answer <> '' qualify row_number() over (partition by answer order by path, id, place) = 1""",
    view=True,
)
def _(t):
    p = t.postings().select(F.col("word").alias("path"), F.col("k").alias("id"), F.create_map(F.lit("formal"), F.col("story"), F.lit("casual"), F.expr(CASUAL)).alias("tones"), F.expr(AGAIN).alias("regen"), F.expr(TURNED).alias("rotated"))
    return R.answers(p)


# ---- The seam ----


@query("judge_seam", f"select k, case when contains(story, '!') then null else array_to_string(list_distinct(regexp_extract_all(story, '[0-9]+'))[1:0] || list_sort(list_distinct(regexp_extract_all(story, '[0-9]+'))), '|') end as flagged from p", view=True)
def _(t):
    from .seam import judged

    rows = t.postings().select("k", F.col("k").cast("string").alias("key"), "title", F.col("word").alias("question"), F.array("source", "ground").alias("evidence"), F.col("story").alias("draft"))
    return rows.select("k", "key").join(judged(rows), "key").select("k", F.array_join("flagged", "|").alias("flagged"))


@query(
    "seam_outcomes",
    f"select k, case k % 8 when 1 then 'RATE_LIMITED' when 2 then 'LLM_UNAVAILABLE' when 3 then 'INVALID_INPUT' when 6 then 'SCHEMA' when 7 then 'LLM_UNAVAILABLE' end as code, case k % 8 when 0 then 1 when 1 then 1 when 2 then 1 when 3 then 1 when 4 then 2 when 5 then 2 when 6 then 2 else 2 end::int as calls from p",
    view=True,
)
def _(t):
    from .seam import StubProvider, outcomes

    marker = F.element_at(F.array(*[F.lit(x) for x in ("", "rate_limited", "timeout", "input", "transient", "schema", "broken", "down")]), (F.col("k") % 8 + 1).cast("int"))
    rows = t.postings().select("k", F.col("k").cast("string").alias("key"), F.lit("keywords").alias("system"), F.concat("title", F.lit(" "), F.col("k").cast("string"), F.lit(" [stub:"), marker, F.lit("]")).alias("user"))
    return rows.select("k", "key").join(outcomes(rows, StubProvider), "key").select("k", "code", "calls")


@query("cache_modes", f"select mode, count(*) as n from (select unnest(['off', 'record', 'replay']) as mode, story from p) where mode <> 'record' or story <> '' group by mode", view=True)
def _(t):
    """How many requests each mode answers; the cache holds every story."""
    from ..operators.ledger import cached

    asked = t.postings().select(F.sha2("story", 256).alias("key"), F.col("story").alias("user"))
    cache = asked.select("key", F.upper("user").alias("answer")).dropDuplicates(["key"])
    answer = lambda df: df.select("key", F.upper("user").alias("answer"))
    each = [cached(asked, cache, mode, answer).select(F.lit(mode).alias("mode"), "answer") for mode in ("off", "record", "replay")]
    return each[0].unionByName(each[1]).unionByName(each[2]).where("answer is not null").groupBy("mode").agg(F.count("*").alias("n"))
