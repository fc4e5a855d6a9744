"""Queries of the rules, over announcements whose facts are known from the columns that they were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import guard as G
from ..functions import patterns as P
from ..functions import text as T
from ..operators import grade as R
from ..sources.postings import DUE, spread
from .registry import query



def due(p: DataFrame) -> DataFrame:
    """p with due, a struct; candidates are a column of their own so that they are found once."""
    return p.withColumn("_hits", E.due_candidates(F.col("body"), F.col("d"))).withColumn("due", E.due_date(F.col("_hits"), F.col("body"))).drop("_hits")


@query(
    "ext_due_date",
    f"select k, {DUE} as iso, case when ({DUE}) is not null then left(date_line, 80) end as raw, ({DUE}) is not null and style = 3 as year_inferred, ({DUE}) is not null and style = 1 as has_time, case when ({DUE}) is null then case when style = 5 then 'no_deadline' else 'not_found' end end as reason from p",
    view=True,
)
def _(t):
    return due(t.postings()).select("k", "due.*")


@query("ext_due_window", "select k, case when style < 5 then date_line || chr(10) end as raw from p", view=True)
def _(t):
    p = t.postings().withColumn("at", F.try_element_at(F.array_sort(E.label_hits(F.col("body"))), F.lit(1))["at"])
    return p.select("k", F.when(F.col("style") < 5, E.window(F.col("body"), F.col("at"))).alias("raw"))


@query("ext_max_chars", "select k, case when asks >= 1 then 400 end::int as n, case when asks = 3 then null else 500 end::int as m from p", view=True)
def _(t):
    second = F.when(F.col("asks") == 3, F.lit("800자 이상")).otherwise(F.lit("100자 이상 500자 이내, 700자"))
    return t.postings().select("k", E.max_chars(F.col("body")).alias("n"), E.max_chars(second).alias("m"))


@query(
    "ext_form_questions",
    "select k, unnest(generate_series(1, asks))::int as n, ['지원 동기를 구체적으로 작성해 주세요', '협업 경험을 구체적으로 작성해 주세요', '앞으로의 계획을 구체적으로 적어 주세요'][unnest(generate_series(1, asks))] as question, [400, 500, null][unnest(generate_series(1, asks))]::int as max_chars from p where asks > 0",
    view=True,
)
def _(t):
    return t.postings().select("k", F.explode(E.form_questions(F.col("body"))).alias("q")).select("k", F.col("q.order").alias("n"), "q.question", "q.max_chars")


@query("ext_qual_lines", "select k, array_to_string(list_filter(['지원자격', '- ' || grade || '학년 이상 재학', case when k % 2 = 0 then '- 평점 3.' || k % 9 || ' 이상' end, case k % 3 when 0 then '- 컴퓨터공학과 재학생' when 1 then '- 전공 무관' end], lambda x: x is not null), '|') as lines from p", view=True)
def _(t):
    return t.postings().select("k", F.array_join(E.qualification_lines(F.col("body")), "|").alias("lines"))


@query("ext_qualifications", "select k, grade || '학년 이상' as year, case when k % 2 = 0 then '평점 3.' || k % 9 || ' 이상' end as gpa, case when k % 3 = 0 then '컴퓨터공학과' end as major from p", view=True)
def _(t):
    return t.postings().withColumn("rows", E.qualification_lines(F.col("body"))).select("k", E.qualifications(F.col("rows")).alias("q")).select("k", "q.*")


@query("ext_preferences", "select k, prefs as n, case prefs when 0 then '' when 1 then '관련 활동 경험 1회' else '관련 활동 경험 1회|관련 활동 경험 2회' end as items from p", view=True)
def _(t):
    items = F.col("items")
    return t.postings().withColumn("items", E.preferences(F.col("body"))).select("k", F.size(items).alias("n"), F.array_join(items, "|").alias("items"))


@query("ext_type", "select k, kind from p", view=True)
def _(t):
    return t.postings().select("k", E.guess_type(F.col("title"), F.col("body")).alias("kind"))


@query("pred_likely_posting", "select k, k % 23 <> 0 as likely, case when k % 23 = 0 then 0 else 2 + (style = 5 or due is not null)::int end::int as score, case when k % 23 = 0 then '수강 신청' when style = 0 then '접수|자격' when style = 3 then '신청|자격' when style in (4, 5) then '모집|자격' else '지원자격|자격' end as hits from (select *, " + DUE + " as due from p)", view=True)
def _(t):
    s = E.signals(F.col("body"), F.col("due.iso").isNotNull() | (F.col("due.reason") == "no_deadline"), F.col("title"))
    return due(t.postings()).select("k", s.alias("s")).select("k", F.col("s.likely_posting").alias("likely"), F.col("s.score").alias("score"), F.array_join("s.hits", "|").alias("hits"))


@query("ext_type_baseline", "select k, case kind when 'activity' then 'activity' else kind end as kind from p", view=True)
def _(t):
    return t.postings().select("k", E.plain_type(F.concat_ws("\n", "title", "body")).alias("kind"))


@query("ext_pref_baseline", r"select k, array_to_string(list_filter(list_transform(string_split_regex(body || chr(10) || story || ' 우대 · ' || word || ' 우대', '[\n·•\-]'), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: not (x like '%:' or x like '%：' or regexp_matches(x, '^우대\s?사?항?[:：]?$')) and contains(x, '우대') and length(x) between 5 and 100)[1:10], '|') as items from p", view=True)
def _(t):
    text = F.concat("body", F.lit("\n"), "story", F.lit(" 우대 · "), "word", F.lit(" 우대"))
    return t.postings().select("k", F.array_join(E.plain_preferences(text), "|").alias("items"))


@query("ext_due_baseline", "select k, case when style <> 5 and year(d + 400) >= 2000 then d + 400 end::date as iso from p", view=True)
def _(t):
    # The last full date of this century wins: the day of the results, a trap that the rules avoid.
    return t.postings().select("k", E.plain_due(F.col("body"), F.col("d")).alias("iso"))


@query("ext_q_baseline", "select k, asks as n, case when asks >= 2 then 2 end::int as second, case when asks >= 1 then 400 end::int as max_chars from p", view=True)
def _(t):
    q = F.col("q")
    p = t.postings().withColumn("q", E.plain_questions(F.regexp_replace("body", r"\(100자 이상 500자 이내\)", "(500자 이내)")))
    return p.select("k", F.size(q).alias("n"), F.try_element_at(q, F.lit(2))["order"].alias("second"), F.try_element_at(q, F.lit(1))["max_chars"].alias("max_chars"))


WORDS = r"list_filter(regexp_extract_all({0}, '[A-Za-z가-힣][A-Za-z0-9가-힣+#.]{{1,19}}'), lambda w: not list_contains([" + ", ".join(f"'{w}'" for w in P.STOPWORDS) + "], w))"


@query(
    "topk_keywords",
    f"""with w as (select doc_id, unnest({WORDS.format("coalesce(source, '')")}) as w, 5 as p, unnest(generate_series(1, len({WORDS.format("coalesce(source, '')")}))) as pos from documents
  union all select doc_id, unnest({WORDS.format("coalesce(text, '')")}), 1, 1000 + unnest(generate_series(1, len({WORDS.format("coalesce(text, '')")}))) from documents),
s as (select doc_id, w, sum(p)::int as points, min(pos) as pos from w group by doc_id, w having sum(p) >= 2),
r as (select *, row_number() over (partition by doc_id order by points desc, pos) as n from s)
select doc_id, w as word, n::int as rank from r where n <= 10""",
)
def _(t):
    return spread(t("documents")).select("doc_id", F.posexplode(E.plain_keywords(F.col("source"), F.col("text"))).alias("at", "word")).select("doc_id", "word", (F.col("at") + 1).alias("rank"))


@query(
    "pipe_baseline",
    f"""with w as (select k, unnest({WORDS.format("title")}) as w, 5 as n, unnest(generate_series(1, len({WORDS.format("title")}))) as pos from p
  union all select k, unnest({WORDS.format("body")}), 1, 1000 + unnest(generate_series(1, len({WORDS.format("body")}))) from p),
s as (select k, w, sum(n)::int as points, min(pos) as pos from w group by k, w having sum(n) >= 2),
r as (select *, row_number() over (partition by k order by points desc, pos) as place from s),
t as (select k, string_agg(w, '|' order by place) as keywords, count(*) >= 3 as ok from r where place <= 10 group by k)
select k, case when ok and style <> 5 and year(d + 400) >= 2000 then d + 400 end::date as due_date, case when ok then kind end as kind, case when ok then asks else 0 end::int as questions, grade || '학년 이상' as year,
  case when k % 2 = 0 then '평점 3.' || k % 9 || ' 이상' end as gpa, case when k % 3 = 0 then '컴퓨터공학과' end as major, case when ok then keywords else '' end as keywords, case when not ok then 'NO_KEYWORDS' end as fail_reason
from (select p.*, coalesce(t.ok, false) as ok, t.keywords from p left join t using (k))""",
    view=True,
)
def _(t):
    p = t.postings().withColumn("text", F.concat_ws("\n", "title", "body")).withColumn("keywords", E.plain_keywords(F.col("title"), F.col("body")))
    ok = F.size("keywords") >= P.MIN_KEYWORDS
    return p.select(
        "k", F.when(ok, E.plain_due(F.col("text"), F.col("d"))).alias("due_date"), F.when(ok, E.plain_type(F.col("text"))).alias("kind"), F.when(ok, F.size(E.plain_questions(F.col("body")))).otherwise(0).alias("questions"),
        T.first_of(F.col("text"), P.PLAIN_YEAR).alias("year"), T.first_of(F.col("text"), P.PLAIN_GPA).alias("gpa"), T.first_of(F.col("text"), P.PLAIN_MAJOR).alias("major"),
        F.array_join(F.when(ok, F.col("keywords")).otherwise(T.texts()), "|").alias("keywords"), F.when(~ok, "NO_KEYWORDS").alias("fail_reason"),
    )


def rules(p: DataFrame) -> DataFrame:
    """The record that the rules make of announcements (k, title, body, d), cleaned first."""
    clean = T.preprocessed(p, "body").withColumn("body", F.col("pre_text"))
    read = due(clean).withColumn("_lines", E.qualification_lines(F.col("body")))
    deadline = F.col("due.iso").isNotNull() | (F.col("due.reason") == "no_deadline")
    return read.withColumns({"kind_found": E.guess_type(F.col("title"), F.col("body")), "questions": E.form_questions(F.col("body")), "quals": E.qualifications(F.col("_lines")), "preferences": E.preferences(F.col("body")), "signals": E.signals(F.col("body"), deadline, F.col("title"))}).drop("_lines")


@query("pipe_rules", f"select k, {DUE} as due_date, kind as kind_found, asks as n_questions, grade || '학년 이상' as year, prefs as n_preferences, k % 23 <> 0 as likely, 2 as masked, case when k % 17 = 0 then 1 else 0 end::int as injections from p", view=True)
def _(t):
    r = rules(t.postings())
    return r.select("k", F.col("due.iso").alias("due_date"), "kind_found", F.size("questions").alias("n_questions"), "quals.year", F.size("preferences").alias("n_preferences"), F.col("signals.likely_posting").alias("likely"), F.col("pre_masked").cast("int").alias("masked"), F.col("pre_injections").cast("int").alias("injections"))


GRADES = f"""select k, style, case when k % 29 = 0 or k % 31 = 0 then 'skip' when style = 5 then 'correct_null' when ({DUE}) is null then 'missed' when ({DUE}) = e then 'correct' else 'wrong' end as due,
  case when k % 29 = 0 or kind is null then 'skip' else 'correct' end as type,
  case when k % 23 = 0 then 'correct' when k % 29 = 0 or kind is null then 'skip' else 'correct' end as posting,
  case when k % 29 = 0 then 'skip' when asks = 2 then 'correct' when asks > 2 then 'false_positive' else 'missed' end as questions from p"""


def graded(p: DataFrame) -> DataFrame:
    """Announcements with a grade for each fact, against the deadline that was meant (none where applications are always open)."""
    r = due(p).withColumn("signals", E.signals(F.col("body"), F.col("due.iso").isNotNull() | (F.col("due.reason") == "no_deadline"), F.col("title")))
    failed, present, reason = F.col("k") % 29 == 0, F.col("k") % 31 != 0, F.when(F.col("k") % 23 == 0, "NOT_A_POSTING")
    return r.select(
        "k", "style", R.due(failed, present, F.when(F.col("style") != 5, F.col("e")), F.col("due.iso")).alias("due"), R.kind(failed, F.col("kind"), E.guess_type(F.col("title"), F.col("body"))).alias("type"),
        R.posting(reason, failed, F.col("kind"), F.col("signals.likely_posting")).alias("posting"), R.questions(failed, F.lit(True), F.lit(2), F.size(E.form_questions(F.col("body")))).alias("questions"),
    )


for _name in ("due", "type", "posting", "questions"):

    @query(f"grade_{_name}", f"select k, {_name} as grade from ({GRADES})", view=True)
    def _(t, name=_name):
        return graded(t.postings()).select("k", F.col(name).alias("grade"))


UNPIVOT = f"(select unnest(['due', 'type', 'posting', 'questions']) as metric, unnest([due, type, posting, questions]) as grade from ({GRADES}))"
METRICS = ["due", "type", "posting", "questions"]


@query("agg_confusion", f"select metric, grade, count(*) as n from {UNPIVOT} group by all", view=True)
def confusion(t):
    return R.confusion(graded(t.postings()), METRICS)


@query("agg_accuracy", f"select metric, count(*) filter (grade <> 'skip') as graded, count(*) filter (grade in ('correct', 'correct_null')) as correct, count(*) filter (grade in ('correct', 'correct_null')) / nullif(count(*) filter (grade <> 'skip'), 0) as accuracy from {UNPIVOT} group by metric", view=True)
def _(t):
    return R.accuracy(R.confusion(graded(t.postings()), METRICS))


@query("due_accuracy_by_style", f"select style, due as grade, count(*) as n from ({GRADES}) group by all", view=True)
def flagship(t):
    """How right the deadline is, by the way in which it is written."""
    return graded(t.postings()).groupBy("style", F.col("due").alias("grade")).agg(F.count("*").alias("n"))


@query("grade_quals", "select k, case when k % 11 = 0 then null else case when grade = 2 then 'correct' else 'wrong' end end as year, case when k % 2 = 0 then case when k % 9 = 5 then 'correct' else 'wrong' end else 'missed' end as gpa, case when k % 3 = 0 then 'hallucinated' else 'correct_null' end as major from p", view=True)
def _(t):
    p = t.postings().withColumn("rows", E.qualification_lines(F.col("body"))).withColumn("q", E.qualifications(F.col("rows")))
    return p.select("k", R.qualification(F.col("k") % 11 != 0, T.texts("2 학년", "없음"), F.col("q.year")).alias("year"), R.qualification(F.lit(True), T.texts("평점 3.5 이상"), F.col("q.gpa")).alias("gpa"), R.qualification(F.lit(True), F.lit(None).cast("array<string>"), F.col("q.major")).alias("major"))


LISTS = "select k, 2 as gold, prefs as hit, prefs as pred, prefs as pred_hit, (prefs = 2)::int as forbidden from p"


def _lists(t):
    gold, bad = T.texts("활동 경험 1회", "관련  활동 경험 2 회"), T.texts("경험 2회")
    return t.postings().withColumn("found", E.preferences(F.col("body"))).select("k", R.lists(gold, F.col("found"), bad).alias("g"))


@query("grade_list", LISTS, view=True)
def _(t):
    return _lists(t).select("k", "g.*")


@query("grade_list_optional", f"select k, gold, hit, pred, pred_hit, forbidden from (select k, case when k % 5 > 0 then gold end as gold, case when k % 5 > 0 then hit end as hit, case when k % 5 > 0 then pred end as pred, case when k % 5 > 0 then pred_hit end as pred_hit, case when k % 5 > 0 then forbidden end as forbidden from ({LISTS}))", view=True)
def _(t):
    return _lists(t).select("k", F.when(F.col("k") % 5 > 0, F.col("g")).alias("g")).select("k", "g.*")


@query("agg_micro_pr", f"select sum(gold)::bigint as gold, sum(hit)::bigint as hit, sum(pred)::bigint as pred, sum(pred_hit)::bigint as pred_hit, sum(forbidden)::bigint as forbidden, sum(hit) / sum(gold) as recall, sum(pred_hit) / sum(pred) as precision from ({LISTS})", view=True)
def _(t):
    return R.micro(_lists(t), "g")


@query("parse_failure_code", "select k, case when k % 13 = 0 and k % 2 = 0 then 'IMAGE_ONLY' when k % 13 = 0 then 'EMPTY' when k % 23 = 0 then 'NOT_A_POSTING' when k % 5 = 4 then 'NO_KEYWORDS' end as code from p", view=True)
def _(t):
    body = F.when(F.col("k") % 13 == 0, "짧은 글").otherwise(F.concat(F.col("body"), F.repeat(F.lit(" 글"), F.lit(100))))
    words = F.when(F.col("k") % 5 == 4, T.texts("하나", "둘")).otherwise(T.texts("하나", "둘", "셋"))
    likely = E.signals(body, F.lit(False), F.col("title"))["likely_posting"]
    return t.postings().select("k", G.failure_code(T.too_short(body), F.col("k") % 2 == 0, likely, G.keyword_hygiene(words)).alias("code"))


@query("kw_hygiene", "select k, case when k % 2 = 0 then word || '|' || seg else seg || '|' || word end as words from p", view=True)
def _(t):
    words = F.when(F.col("k") % 2 == 0, F.array(F.concat(F.lit(" "), F.col("word")), F.lit(""), F.col("seg"), F.col("word"))).otherwise(F.array(F.col("seg"), F.lit("용모 단정한 분"), F.col("word"), F.repeat(F.lit("x"), F.lit(41))))
    return t.postings().select("k", F.array_join(G.keyword_hygiene(words), "|").alias("words"))


@query("merge_precedence", "select k, coalesce(kind, 'other') as kind, case when prefs > 0 then prefs else 1 end as n_preferences, case when asks > 0 then asks else 2 end as n_questions from p", view=True)
def _(t):
    own, asks = E.preferences(F.col("body")), E.form_questions(F.col("body"))
    model = F.filter(T.texts("모델이 말한 우대", "용모 단정"), lambda x: F.size(E.discriminatory(x)) == 0)
    model_asks = F.filter(T.texts("지원 동기를 적어 주세요", "계좌번호를 적어 주세요", "장점을 적어 주세요"), lambda x: ~T.found(x, P.SENSITIVE, "i"))
    return t.postings().select("k", F.coalesce(E.guess_type(F.col("title"), F.col("body")), F.lit("other")).alias("kind"), F.size(F.slice(F.when(F.size(own) > 0, own).otherwise(model), 1, P.MAX_KEYWORDS)).alias("n_preferences"), F.when(F.size(asks) > 0, F.size(asks)).otherwise(F.size(F.slice(model_asks, 1, P.MAX_QUESTIONS))).alias("n_questions"))
