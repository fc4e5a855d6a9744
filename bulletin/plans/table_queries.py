"""Queries of joins, reports, rankings and the ledger over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import ledger as L
from ..operators import rank as R
from ..sources.postings import DUE
from .guard_queries import _unlawful
from .registry import query
from .text_queries import PREPROCESSED

# ---- Joins ----


@query("join_left_labels", "select d.doc_id, l.quality, l.toxic from documents d left join labels l using (doc_id)")
def _(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left")


@query("join_inner_case", "select c.conv_id, c.turn, d.lang from conversations c join documents d on c.conv_id = d.doc_id")
def _(t):
    c, d = t("conversations").select("conv_id", "turn"), t("documents").select(F.col("doc_id").alias("conv_id"), "lang")
    return c.join(d, "conv_id")


@query("join_anti_excluded", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def _(t):
    return t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left_anti")


@query("join_semi_labeled", "select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def _(t):
    return t("documents").select("doc_id", "source").join(t("labels").where("quality = 1"), "doc_id", "left_semi")


@query("cache_miss_anti", "select distinct sha256(b.text) as key from benchmark b where sha256(b.text) not in (select sha256(text) from documents where text is not null)")
def _(t):
    key = F.sha2("text", 256).alias("key")
    return L.misses(t("benchmark").select(key), t("documents").where("text is not null").select(key))


@query("embed_cache_anti", "select distinct sha256('m' || chr(10) || text) as key from conversations where role = 'user' and text not in (select text from conversations where role = 'system')")
def _(t):
    key = F.sha2(F.concat(F.lit("m\n"), "text"), 256).alias("key")
    c = t("conversations")
    return L.misses(c.where("role = 'user'").select(key), c.where("role = 'system'").select(key))


@query("dedup_keep_first", "select text, min(doc_id) as doc_id from documents group by text")
def _(t):
    # The smallest doc_id of each text; partial sums before the shuffle, so one frequent text isn't one task's.
    return t("documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("agg_unique_texts", "select source, count(distinct text) as n_texts, count(*) as n from documents group by source")
def _(t):
    one = t("documents").groupBy("source", "text").agg(F.count("*").alias("n"))
    return one.groupBy("source").agg(F.count("text").alias("n_texts"), F.sum("n").alias("n"))


@query("theta_contains", "select doc_id, len(list_filter(string_split(text, ' '), lambda w: list_contains(['the', 'and', 'of'], lower(w)) or contains(lower(w), 'tion'))) as n from documents where text is not null")
def _(t):
    hit = lambda w: F.lower(w).isin("the", "and", "of") | F.contains(F.lower(w), F.lit("tion"))
    return t("documents").where("text is not null").select("doc_id", F.size(F.filter(F.split("text", " "), hit)).cast("long").alias("n"))


# ---- Similarity and ranking: profiles are the mean vectors of the labels ----

MEANS = "m as (select label as profile, list(v order by i) as mean from (select label, i, avg(v) as v from (select label, unnest(embedding)::double as v, unnest(generate_series(1, len(embedding))) as i from embeddings) group by label, i) group by label)"
COS = "list_cosine_similarity(e.embedding::double[], m.mean)"
SCORES = f"with {MEANS}, s as (select m.profile, e.vec_id, round({COS}, 9) as score, e.label = m.profile as relevant, (e.vec_id * 7919 % 1000) / 1000.0::double as other from embeddings e cross join m)"


def scores(t):
    """Every vector against every profile: profiles are few, one a label, and Spark broadcasts them by their size."""
    e = t("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    parts = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = parts.groupBy(F.col("label").alias("profile")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m")).select("profile", F.transform("m", lambda s: s["x"]).alias("mean"))
    s = e.crossJoin(means).select("profile", "vec_id", F.round(R.cosine(F.col("v"), F.col("mean")), 9).alias("score"), (F.col("label") == F.col("profile")).alias("relevant"), ((F.col("vec_id") * 7919 % 1000) / 1000).alias("other"))
    return s


@query("cross_scores", f"{SCORES} select profile, vec_id, round(score, 6) as score, relevant from s")
def _(t):
    return scores(t).select("profile", "vec_id", F.round("score", 6).alias("score"), "relevant")


@query("sim_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def _(t):
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(n, "vec_id").select("vec_id", F.round(R.cosine(F.col("v"), F.col("w")), 6).alias("score"))


@query("sim_calibrate", "select vec_id, greatest(0, least(100, floor((x - 0.365::double) / (0.509::double - 0.365::double) * 100 + 0.5)))::int as score from (select vec_id, (vec_id % 1000) / 1000.0::double as x from embeddings)")
def _(t):
    return t("embeddings").select("vec_id", R.calibrate((F.col("vec_id") % 1000) / 1000).alias("score"))


@query("sim_keyword_score", "select k, case k % 3 when 0 then 67 when 1 then 0 else 100 end::int as score from p", view=True)
def _(t):
    words = F.when(F.col("k") % 3 == 0, F.array("word", "seg", F.lit("무관"))).when(F.col("k") % 3 == 1, T.texts()).otherwise(F.array(*["word"] * 6))
    interests = F.array(F.concat(F.lit("관심 "), "word"), F.lower("seg"))
    return t.postings().select("k", R.keyword_score(words, interests).alias("score"))


@query("sim_keyword_batch", "select k, pos::int as pos, case pos when 0 then 100 else 0 end::int as score from p cross join (values (0), (1)) v(pos)", view=True)
def _(t):
    rows = t.postings().select("k", "word", F.posexplode(F.array(F.array("word"), F.array(F.lit("무관")))).alias("pos", "keywords"))
    return rows.select("k", "pos", R.keyword_score(F.col("keywords"), F.array("word")).alias("score"))


@query("sim_interest_texts", "select k, 'A|개발|Z|' || word as texts from p", view=True)
def _(t):
    labels = F.create_map(F.lit("A"), F.lit("개발"))
    return t.postings().select("k", F.array_join(R.interest_texts(T.texts("A", "Z"), F.array("word"), labels), "|").alias("texts"))


@query("rank_auc", f"{SCORES}, w as (select a.profile, avg(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end) as auc from s a join s b on a.profile = b.profile and a.relevant and not b.relevant group by a.profile) select profile, round(auc, 6) as auc from w")
def _(t):
    return R.auc(scores(t), ["profile"], "score", "relevant").where("auc is not null").select("profile", F.round("auc", 6).alias("auc"))


RP = """, g as (select profile, {0} as score, count(*) as n, count(*) filter (relevant) as pos from s group by 1, 2),
h as (select *, sum(pos) over (partition by profile) as r, coalesce(sum(n) over (partition by profile order by score desc rows between unbounded preceding and 1 preceding), 0) as before from g)
select profile, round(sum(least(n, greatest(r - before, 0)) * pos / n) / nullif(max(r), 0), 6) as value from h group by profile"""


@query("rank_r_precision", SCORES + RP.format("floor(other * 10)"))
def _(t):
    rows = scores(t).withColumn("score", F.floor(F.col("other") * 10))
    return R.r_precision(rows, ["profile"], "score", "relevant").select("profile", F.round("r_precision", 6).alias("value"))


@query("topk_per_profile", f"{SCORES} select profile, rank::int as rank, vec_id from (select *, row_number() over (partition by profile order by score desc, vec_id) as rank from s) where rank <= 3")
def _(t):
    return R.top_k(scores(t), ["profile"], [F.col("score").desc(), F.col("vec_id")], 3).select("profile", F.col("rank").cast("int").alias("rank"), "vec_id")


@query("agg_auc_macro", f"{SCORES}, w as (select a.profile, avg(case when a.other > b.other then 1.0 when a.other = b.other then 0.5 else 0 end) as auc from s a join s b on a.profile = b.profile and a.relevant and not b.relevant group by a.profile) select round(avg(auc), 6) as macro_auc, count(*) as profiles from w")
def _(t):
    return R.auc(scores(t), ["profile"], "other", "relevant").agg(F.round(F.coalesce(F.avg("auc"), F.lit(float("nan"))), 6).alias("macro_auc"), F.count("auc").alias("profiles"))


@query("agg_zero_errors", f"{SCORES} select count(*) filter (score <= 0.1 and relevant) as relevant_zero, count(*) filter (score <= 0.1) as zero, count(*) as n from s")
def _(t):
    low = F.col("score") <= 0.1
    return scores(t).agg(F.count_if(low & F.col("relevant")).alias("relevant_zero"), F.count_if(low).alias("zero"), F.count("*").alias("n"))


@query("boot_auc_ci")
def _(t):
    rows = scores(t).select("profile", F.col("vec_id").cast("int").alias("item"), F.col("other").alias("a"), F.col("score").alias("b"), F.col("relevant").alias("label"))
    return R.bootstrap_auc_difference(rows)


@query("sim_score_pipeline")
def _(t):
    from ..plans.seam import field_similarity

    return field_similarity(t.postings().select(F.col("k").alias("id"), "title", F.array("word", "seg").alias("keywords")), T.joined_nonempty(T.texts("AUTOMOBILE", "채용 개발")))


GRAMS = r"list_distinct(list_transform(generate_series(1, greatest(length(x) - 2, 0)), lambda i: substring(x, i::int, 3)))"


@query("agg_auc_pooled", f"{SCORES}, g as (select score, count(*) filter (relevant) as pos, count(*) filter (not relevant) as neg from s group by score), h as (select *, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from g) select sum(pos)::bigint as pos, sum(neg)::bigint as neg, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) as auc from h")
def _(t):
    return R.pooled_auc(scores(t), "score", "relevant").select("pos", "neg", F.round("auc", 6).alias("auc"))


@query("selfjoin_jaccard", rf"""with g as (select conv_id, turn, case when length(x) >= 3 then {GRAMS} else [] end as g from (select conv_id, turn, regexp_replace(coalesce(text, ''), '\s', '', 'g') as x from conversations)),
s as (select a.conv_id, a.turn as a, b.turn as b, len(list_intersect(a.g, b.g)) as c, len(a.g) as n, len(b.g) as m from g a join g b on a.conv_id = b.conv_id and a.turn < b.turn)
select conv_id, a, b, case when n + m = 0 then 1.0 else round(c / (n + m - c), 9) end::double as score from s""")
def _(t):
    """Every two turns of a conversation: rows hold their n-grams, so that only pairs of turns are joined, not pairs of n-grams."""
    bare = t("conversations").select("conv_id", "turn", T.sub(F.coalesce("text", F.lit("")), r"\s").alias("x"))
    grams = bare.select("conv_id", "turn", T.ngrams(F.col("x")).alias("g"))
    a, b = grams.select("conv_id", F.col("turn").alias("a"), "g"), grams.select("conv_id", F.col("turn").alias("b"), F.col("g").alias("h"))
    both = a.join(b, "conv_id").where("a < b").select("conv_id", "a", "b", F.size("g").alias("n"), F.size("h").alias("m"), F.size(F.array_intersect("g", "h")).alias("c"))
    either = F.col("n") + F.col("m") - F.col("c")
    return both.select("conv_id", "a", "b", F.when(either == 0, 1.0).otherwise(F.round(F.col("c") / either, 9)).alias("score"))


# ---- Reports ----


@query("label_threshold", "select d.doc_id, coalesce(l.quality + l.toxic, 0) >= 1 as relevant, coalesce(l.quality + l.toxic, 0) >= 2 as strict from documents d left join labels l using (doc_id)")
def _(t):
    g = F.coalesce(F.col("quality") + F.col("toxic"), F.lit(0))
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left").select("doc_id", (g >= 1).alias("relevant"), (g >= 2).alias("strict"))


MODEL = "case event_id % 4 when 0 then 'HCX-DASH-002' when 1 then 'HCX-005' when 2 then 'HCX-007' else 'other' end"
#: In hundred-thousandths, so that halves go to the even neighbour exactly.
UNITS = "((100 + event_id % 997) * (case event_id % 4 when 0 then 25 when 3 then 0 else 125 end) + (event_id % 311) * (case event_id % 4 when 0 then 100 when 3 then 0 else 500 end))"
COST = f"(({UNITS} // 10 + case when {UNITS} % 10 > 5 or ({UNITS} % 10 = 5 and {UNITS} // 10 % 2 = 1) then 1 else 0 end) / 10000)"


def calls(t):
    """Events as calls of models: tokens, cost, latency."""
    e = t("events")
    model = F.when(F.col("event_id") % 4 == 0, "HCX-DASH-002").when(F.col("event_id") % 4 == 1, "HCX-005").when(F.col("event_id") % 4 == 2, "HCX-007").otherwise("other")
    e = e.withColumns({"model": model, "prompt": 100 + F.col("event_id") % 997, "completion": F.col("event_id") % 311})
    return e.withColumn("cost", L.cost(F.col("model"), F.col("prompt"), F.col("completion")))


@query("cost_per_call", f"select event_id, {COST} as cost from events")
def _(t):
    return calls(t).select("event_id", "cost")


@query("cost_estimate", "select event_id, round((length(event_type) + 20) * (case event_id % 4 when 0 then 0.00025 when 3 then 0 else 0.00125 end)::double + 4596 * (case event_id % 4 when 0 then 0.001 when 3 then 0 else 0.005 end)::double, 9) as estimate from events")
def _(t):
    return calls(t).select("event_id", F.round(L.estimate(F.col("model"), F.lit("x" * 20), F.col("event_type"), F.lit(500), F.lit(4096)), 9).alias("estimate"))


@query("agg_usage", f"select {MODEL} as model, count(*) as calls, sum(100 + event_id % 997)::bigint as prompt_tokens, sum(event_id % 311)::bigint as completion_tokens, round(sum({COST}), 4) as cost from events group by 1")
def _(t):
    return calls(t).groupBy("model").agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt_tokens"), F.sum("completion").alias("completion_tokens"), F.round(F.sum("cost"), 4).alias("cost"))


@query("agg_upper_median", "select event_type, list_sort(list(value))[count(value) // 2 + 1] as p50 from events where value is not null group by event_type")
def _(t):
    # The row that has half of its group's rows below it; windows over distinct values, not over rows.
    tied = t("events").where("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    own = W.partitionBy("event_type")
    upto = F.sum("n").over(own.orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    return tied.withColumns({"upto": upto, "half": F.floor(F.sum("n").over(own) / 2)}).where("upto > half").groupBy("event_type").agg(F.min("value").alias("p50"))


@query("agg_ledger", "select ts::date as day, round(sum(value), 4) as cost from events where value > 0 group by 1")
def _(t):
    return L.daily(t("events"), "ts", "value")


@query("agg_ledger_month", "select month, round(sum(cost), 4) as cost from (select strftime(ts, '%Y-%m') as month, ts::date as day, round(sum(value), 4) as cost from events where value > 0 group by 1, 2) group by month")
def _(t):
    return L.monthly(L.daily(t("events"), "ts", "value"))


@query("budget_status", "with d as (select ts::date as day, round(sum(value), 4) as cost from events where value > 0 group by 1), m as (select max(day) as today from d) select round(sum(case when day = today then cost else 0 end), 2) as today_krw, round(sum(case when strftime(day, '%Y-%m') = strftime(today, '%Y-%m') then cost else 0 end), 2) as month_krw, 250.0::double as daily_limit_krw, 5000.0::double as monthly_limit_krw from d, m")
def _(t):
    days = L.daily(t("events"), "ts", "value")
    today = days.agg(F.max("day").alias("d")).first()["d"]
    return L.budget_status(days, F.lit(today), 250.0, 5000.0)


@query("record_lookup", "select d.doc_id, coalesce(r.words, '') as words from (select distinct doc_id from documents) d left join (select doc_id, string_agg(text, '|' order by turn) as words from conversations c join (select distinct doc_id from documents) x on c.conv_id = x.doc_id where role = 'user' group by doc_id) r using (doc_id)")
def _(t):
    said = t("conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x")).select("doc_id", F.transform("x", lambda s: s["text"]).alias("words"))
    return L.recorded(t("documents").select("doc_id").distinct(), said, "doc_id", "words").select("doc_id", F.array_join("words", "|").alias("words"))


@query(
    "budget_admission",
    """with c as (select user_id, list({'ts': ts, 'id': event_id, 'day': ts::date, 'month': strftime(ts, '%Y-%m'), 'e': value::double * 1.5, 'c': value::double} order by ts, event_id) as calls from events where value is not null group by user_id),
f as (select user_id, list_reduce(calls, lambda a, x: {'ts': x.ts, 'id': a.id, 'day': x.day, 'month': x.month,
  'e': case when (case when a.day = x.day then a.e else 0 end) + x.e <= 300 and (case when a.month = x.month then a.c else 0 end) + x.e <= 2000 then (case when a.day = x.day then a.e else 0 end) + greatest(x.c, 0) else (case when a.day = x.day then a.e else 0 end) end,
  'c': case when (case when a.day = x.day then a.e else 0 end) + x.e <= 300 and (case when a.month = x.month then a.c else 0 end) + x.e <= 2000 then (case when a.month = x.month then a.c else 0 end) + greatest(x.c, 0) else (case when a.month = x.month then a.c else 0 end) end},
  {'ts': null::timestamp, 'id': 0::bigint, 'day': null::date, 'month': null::varchar, 'e': 0.0::double, 'c': 0.0::double}) as s from c)
select user_id, s.month as month, round(s.c, 4) as spent_month from f""",
)
def _(t):
    e = t("events").where("value is not null").withColumn("estimate", F.col("value") * 1.5)
    out = L.admitted(e, ["user_id"], ["ts", "event_id"], "estimate", "value", 300.0, 2000.0)
    return out.select("user_id", "month", F.round("spent_month", 4).alias("spent_month"))


@query("retry_gate", "select event_id, 16 - (event_id % 170) / 10.0 >= case when event_id % 5 = 0 then 3 when event_id % 7 = 0 then 0.2 else (event_id % 9000) / 1000.0 end + 1 as ok from events")
def _(t):
    i = F.col("event_id")
    return t("events").select("event_id", L.may_retry((i % 170) / 10, F.when(i % 5 != 0, i % 9000), i % 7 == 0).alias("ok"))


@query("err_status", "select event_id, case event_id % 4 when 0 then 400 when 1 then 429 when 2 then 503 end::int as status from events")
def _(t):
    code = F.element_at(F.array(*[F.lit(c) for c in P.STATUS], F.lit("NONE")), (F.col("event_id") % 4 + 1).cast("int"))
    return t("events").select("event_id", L.status(code).alias("status"))


@query("cfg_model_for", "select event_id, coalesce(case when event_type = 'click' then 'HCX-005' end, 'HCX-DASH-002') as model from events")
def _(t):
    return t("events").select("event_id", F.coalesce(F.when(F.col("event_type") == "click", "HCX-005"), F.lit("HCX-DASH-002")).alias("model"))


@query("cache_key", "select doc_id, sha256(length('m') || ':m|' || case when lang is null then '-' else length(lang) || ':' || lang end || '|' || case when text is null then '-' else length(text) || ':' || text end) as key from documents")
def _(t):
    return t("documents").select("doc_id", L.cache_key(F.lit("m"), F.col("lang"), F.col("text")).alias("key"))


@query("sample_stratified", "select lang, doc_id, kind from (select lang, doc_id, 'hit' as kind, row_number() over (partition by lang order by doc_id) as n from documents where contains(text, '***') qualify n <= 2) union all (select lang, doc_id, 'none' from (select lang, doc_id, row_number() over (order by doc_id) as n, count(*) over () as total from documents where not contains(text, '***')) where (n - 1) % greatest(1, total // 8) = 0 and (n - 1) // greatest(1, total // 8) < 8)")
def _(t):
    d = t("documents").where("text is not null").select("lang", "doc_id", F.contains("text", F.lit("***")).alias("hit"))
    hits = R.top_k(d.where("hit"), ["lang"], [F.col("doc_id")], 2).select("lang", "doc_id", F.lit("hit").alias("kind"))
    # Every n-th of the others: the stride's places are found by ranges, so that no window holds all rows.
    rest = d.where("not hit")
    total = rest.count()
    step = max(1, total // 8)
    width = max(1, 4096)
    part = F.floor(F.col("doc_id") / width)
    before = rest.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "first")
    place = F.col("first") + F.row_number().over(W.partitionBy("part").orderBy("doc_id")) - 1
    others = rest.withColumn("part", part).join(before, "part").withColumn("place", place).where((F.col("place") % step == 0) & (F.col("place") < 8 * step))
    return hits.unionByName(others.select("lang", "doc_id", F.lit("none").alias("kind")))


@query("agg_judge", "select count(*) filter (toxic = 1) as cases, count(*) filter (toxic = 1 and hit) as found, count(*) filter (toxic = 0 and hit) as wrong, count(*) filter (toxic = 1 and hit) / count(*) filter (toxic = 1) as recall, count(*) filter (toxic = 0 and hit) / count(*) filter (toxic = 0) as false_rate from (select l.toxic, contains(d.text, 'idiot') or contains(d.text, 'trash') as hit from labels l join documents d using (doc_id))")
def _(t):
    hit = F.contains("text", F.lit("idiot")) | F.contains("text", F.lit("trash"))
    rows = t("labels").join(t("documents").select("doc_id", hit.alias("hit")), "doc_id")
    bad, good = F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)
    found, wrong = F.count_if((F.col("toxic") == 1) & F.col("hit")), F.count_if((F.col("toxic") == 0) & F.col("hit"))
    return rows.agg(bad.alias("cases"), found.alias("found"), wrong.alias("wrong"), (found / F.nullif(bad, F.lit(0))).alias("recall"), (wrong / F.nullif(good, F.lit(0))).alias("false_rate"))


@query(
    "pipe_merged",
    f"""with b as ({PREPROCESSED}),
w as (select p.*, length(pre_text) < {P.MIN_CHARS} as short, k % 23 <> 0 as likely, list_transform(list_sort(list_transform(list_distinct(list_filter(string_split_regex(pre_text, '\\s+'), lambda x: x <> '')), lambda x: {{'n': -length(x), 'x': x}}))[1:5], lambda z: z.x) as longest from p join b using (k)),
h as (select *, case when short or not likely then []::varchar[] else list_filter(longest, lambda z: length(z) <= 40 and len({_unlawful('z')}) = 0) end as keywords from w),
c as (select *, case when short then 'EMPTY' when not likely then 'NOT_A_POSTING' when len(keywords) < {P.MIN_KEYWORDS} then 'NO_KEYWORDS' end as code from h)
select k, code, case when code is null then {DUE} end as due_date, case when code is null then coalesce(kind, 'other') end as kind, case when code is null then len(keywords) else 0 end::int as n_keywords, case when code is null then asks else 0 end::int as n_questions from c""",
    view=True,
)
def _(t):
    from .seam import merged

    return merged(t.postings())


@query("stream_daily_spend", "select ts::date as day, round(sum(value), 4) as cost from events where value > 0 group by 1")
def _(t):
    from ..streaming.ledger import daily_spend

    return daily_spend(t("events").select("ts", "value"))
