"""Queries of the guards on generated text, and of the measures of drafts and comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import guard as G
from ..functions import patterns as P
from ..functions import text as T
from ..operators import grade as R
from .registry import query
from .text_queries import SENTENCES


# ---- The same checks as SQL for DuckDB, over columns ----

KEY = r"lower(regexp_replace({0}, '[\s,]', '', 'g'))"
JOINED = "array_to_string(list_sort(list_distinct({0})), '|')"


def _list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]::varchar[]"


def _facts(c: str, hay: str) -> str:
    """Numbers, Latin words and spellings of c that the key of the sources lacks."""
    digits = r"regexp_replace(t, '\D', '', 'g')"
    numbers = rf"list_filter(list_transform(regexp_extract_all({c}, '{P.NUMBER}'), lambda t: trim(t)), lambda t: length({digits}) >= 2 and not contains({hay}, {KEY.format('t')}) and not contains({hay}, {digits}))"
    other = " ".join(f"when '{v}' then '{k}'" for k, vs in P.SPELLINGS.items() for v in vs)
    latin = rf"list_filter(regexp_extract_all({c}, '{P.LATIN}'), lambda t: not contains({hay}, {KEY.format('t')}) and not coalesce(contains({hay}, case {KEY.format('t')} {other} end), false))"
    return f"list_concat(list_concat({numbers}, {latin}), {_spelled(c, hay)})"


def _spelled(c: str, hay: str) -> str:
    out = []
    for k, vs in P.SPELLINGS.items():
        left = c
        for longer in (*P.NOT_SPELLINGS, *sorted((x for x in P.SPELLINGS if k in x and x != k), key=len, reverse=True)):
            left = f"replace({left}, '{longer}', ' ')"
        known = " or ".join(f"contains({hay}, '{x}')" for x in (k, *vs))
        out.append(f"case when contains({left}, '{k}') and not ({known}) then '{k}' end")
    return f"list_filter([{', '.join(out)}]::varchar[], lambda x: x is not null)"


def _final(ch: str) -> str:
    return f"(case when unicode({ch}) between 44032 and 55203 then (unicode({ch}) - 44032) % 28 else -1 end)"


def _past(c: str) -> str:
    return f"(len(list_filter(regexp_extract_all({c}, '[가-힣]'), lambda ch: ch not in ('있', '겠') and {_final('ch')} = 20)) > 0)"


def _future(c: str) -> str:
    open_ = rf"regexp_replace({c}, '수\s?있었', 'X', 'g')"
    return rf"(regexp_matches({c}, '{P.FUTURE}') or len(list_filter(regexp_extract_all({open_}, '([가-힣])\s?(?:것|수\s?있)', 1), lambda ch: {_final('ch')} = 8)) > 0)"


def _reactions(c: str, hay: str) -> str:
    free = [f"case when not regexp_matches({hay}, '{ground.replace('(?!형)', '')}') then {_list(words)} else [] end" for words, ground in P.OUTCOMES.values()]
    clauses = f"list_filter(flatten(list_transform({SENTENCES.format(c)}, lambda z: string_split(z, ','))), lambda y: {_past('y')} and not {_future('y')})"
    return f"flatten(list_transform({clauses}, lambda y: list_filter(list_concat({free[0]}, {free[1]}), lambda w: contains(y, w))))"


def _claimed(c: str, hay: str) -> str:
    own = [f"case when len(list_filter({_list(ws)}, lambda w: contains({hay}, w))) > 0 then []::varchar[] else list_filter({_list(ws)}, lambda w: contains({c}, w)) end" for ws in P.CLAIMS.values()]
    return f"list_concat(list_concat(list_concat({own[0]}, {own[1]}), {own[2]}), {_reactions(c, hay)})"


def _cited(c: str, g: str) -> str:
    compact, ground = f"lower(replace({c}, ' ', ''))", f"lower(replace({g}, ' ', ''))"
    words = f"list_transform(regexp_extract_all({g}, '{P.TOKEN}'), lambda w: lower(w))"
    return f"((length({ground}) > 0 and contains({compact}, {ground})) or (len({words}) > 0 and len(list_filter({words}, lambda w: contains({compact}, w))) * 2 >= len({words})))"


def _any_cited(c: str) -> str:
    return f"((ground <> '' and {_cited(c, 'ground')}) or (ground2 <> '' and {_cited(c, 'ground2')}))"


def _kept(c: str) -> str:
    kept = f"list_filter({SENTENCES.format(c)}, lambda z: {_any_cited('z')})"
    return f"case when len({kept}) > 0 then array_to_string({kept}[1:{P.MAX_SENTENCES}], ' ') end"


def _dropped(c: str, flags: str) -> str:
    """Without the sentences that hold a flag; stories are one line."""
    ends = rf"string_split(regexp_replace({c}, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1))"
    clean = rf"list_filter({ends}, lambda z: trim(z) <> '' and len(list_filter({flags}, lambda f: f <> '' and contains({KEY.format('z')}, {KEY.format('f')}))) = 0)"
    return f"case when len({flags}) = 0 then {c} else trim(array_to_string({clean}, ' ')) end"


def _unlawful(c: str) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({c}, '{p}') then '{name}' end" for name, p in P.DISCRIMINATORY.items()) + "]::varchar[], lambda x: x is not null)"


SCRUBBED = r"regexp_replace({0}, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.]+|\b0\d{{1,2}}[-.)]\s?\d{{3,4}}[-.]\d{{4}}\b|\b01[016-9][-.]?\d{{3,4}}[-.]?\d{{4}}\b|\b\d{{6}}[-\s]?[1-4]\d{{6}}\b', '[삭제]', 'g')"


def _grounds():
    return F.array("ground", "ground2")


@query("guard_extract_json", "select conv_id, turn, case when role = 'system' then null else '{\"n\":' || turn || ',\"said\":' || to_json(coalesce(text, ''))::varchar || '}' end as json from conversations")
def _(t):
    said = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("said"), F.col("turn").alias("n")))
    answer = F.when(F.col("role") == "system", F.regexp_replace("text", "[{}]", "")).when(F.col("turn") % 2 == 0, F.concat(F.lit("Here: ```json\n"), said, F.lit("\n``` done"))).otherwise(F.concat(F.lit("so "), said, F.lit(" it is")))
    return t("conversations").select("conv_id", "turn", G.extract_json(answer).alias("json"))


@query("guard_fact_check", f"select k, {JOINED.format(_facts('story', 'hay'))} as flags from (select *, {KEY.format('source')} as hay from p)", view=True)
def _(t):
    return t.postings().select("k", F.array_join(F.array_sort(G.fact_check(F.col("story"), F.array("source"))), "|").alias("flags"))


TURN = "(select a.conv_id, a.turn, a.text as a, b.text as b from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn - 1 where a.role = 'assistant')"


@query("guard_fact_check_turns", rf"""with x as (select conv_id, turn, {KEY.format('b')} as hay, regexp_extract_all(a, '[A-Za-z][A-Za-z0-9+#./-]{{1,}}') as words from {TURN}),
y as (select conv_id, turn, list_distinct(list_filter(words, lambda w: not contains(hay, lower(w)))) as f from x) select conv_id, turn, len(f) as n from y""")
def _(t):
    c = t("conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("b"))
    both = c.where("role = 'assistant'").join(before, ["conv_id", "turn"]).withColumn("hay", T.norm_key(F.col("b")))
    latin = F.array_distinct(F.filter(T.found_all(F.col("text"), P.LATIN), lambda w: ~F.contains(F.col("hay"), F.lower(w))))
    return both.select("conv_id", "turn", F.size(latin).cast("long").alias("n"))


@query("guard_spelling", f"select k, {JOINED.format(_spelled('story', 'hay'))} as found from (select *, {KEY.format('source')} as hay from p)", view=True)
def _(t):
    p = t.postings().withColumn("hay", G.haystack(F.array("source")))
    return p.select("k", F.array_join(F.array_sort(G.spellings(F.col("story"), F.col("hay"))), "|").alias("found"))


@query("guard_claims", f"select k, {JOINED.format(_claimed('story', 'source'))} as claims from p", view=True)
def _(t):
    return t.postings().select("k", F.array_join(F.array_sort(G.claims(F.col("story"), F.array("source"))), "|").alias("claims"))


@query("guard_outcomes", f"select k, {JOINED.format(_reactions('story', 'source'))} as found from p", view=True)
def _(t):
    return t.postings().select("k", F.array_join(F.array_sort(F.array_distinct(G.outcomes(F.col("story"), F.col("source")))), "|").alias("found"))


@query("hangul_past", f"select k, {_past('story')} as past, {_future('story')} as future, {_final('right(source, 1)')}::int as final from p", view=True)
def _(t):
    return t.postings().select("k", G.past(F.col("story")).alias("past"), G.future(F.col("story")).alias("future"), G.final_of(F.right("source", F.lit(1))).alias("final"))


def _ratio(tone: str) -> str:
    own = SENTENCES.format("story")
    return f"len(list_filter({own}, lambda z: regexp_matches(regexp_replace(z, '" + P.TRAILING.replace("'", "''") + f"', ''), '{P.ENDINGS[tone]}'))) / nullif(len({own}), 0)"


@query("guard_ending_ratio", f"select k, {_ratio('formal')} as formal, {_ratio('casual')} as casual from p", view=True)
def _(t):
    return t.postings().select("k", G.ending_ratio(F.col("story"), "formal").alias("formal"), G.ending_ratio(F.col("story"), "casual").alias("casual"))


@query("guard_discriminatory", f"select k, array_to_string({_unlawful('story')}, '|') as hits from p", view=True)
def _(t):
    return t.postings().select("k", F.array_join(E.discriminatory(F.col("story")), "|").alias("hits"))


@query("guard_blocklist", "select doc_id, array_to_string(list_filter(['trash', 'idiot', 'clown'], lambda w: contains(text, w)), '|') as hits from documents")
def _(t):
    return t("documents").select("doc_id", F.array_join(G.blocked(F.col("text"), ("trash", "idiot", "clown")), "|").alias("hits"))


@query("eval_forbidden", rf"select doc_id, len(list_filter(['of The', 'und, die', ''], lambda w: w <> '' and contains({KEY.format('text')}, {KEY.format('w')}))) as n from documents")
def _(t):
    d = t("documents").withColumn("key", T.norm_key(F.col("text")))
    return d.select("doc_id", F.size(G.forbidden_hits(F.col("key"), T.texts("of The", "und, die", ""))).cast("long").alias("n"))


@query("guard_cites", f"select k, {_cited('story', 'ground')} as cites from p", view=True)
def _(t):
    return t.postings().select("k", G.cites(F.col("story"), F.col("ground")).alias("cites"))


@query("guard_keep_cited", f"select k, {_kept('story')} as text from p", view=True)
def _(t):
    return t.postings().select("k", G.keep_cited(F.col("story"), _grounds()).alias("text"))


def _overclaimed(c: str) -> str:
    """The first short ground that stands before an ability; both grounds are plain words but for their plus sign."""
    one = lambda g: rf"case when {g} <> '' and length({g}) <= {P.SHORT_GROUND} and regexp_matches({c}, replace({g}, '+', '\+') || '\s*(?:관련\s*)?{P.CAPABILITY}') then {g} end"
    return f"coalesce({one('ground')}, {one('ground2')})"


@query("guard_overclaim", f"select k, {_overclaimed('story')} as ground from p", view=True)
def _(t):
    return t.postings().select("k", G.overclaimed(F.col("story"), _grounds()).alias("ground"))


@query("eval_grounded", f"select k, len(list_filter({SENTENCES.format('story')}, lambda z: not {_any_cited('z')})) = 0 as grounded from p", view=True)
def _(t):
    return t.postings().select("k", G.grounded(F.col("story"), _grounds()).alias("grounded"))


@query(
    "guard_comments",
    f"""with c as (select k, ground, ground2, {_kept('story')} as cited, ground || ' ' || ground2 as source from p),
f as (select *, list_concat({_facts('cited', 'hay')}, {_claimed('cited', 'source')}) as flags from (select *, {KEY.format('source')} as hay from c where cited is not null)),
l as (select k, ground, ground2, {_dropped('cited', 'flags')} as clean from f),
r as (select *, {_kept('clean')} as text from l)
select p.k, case when len({_unlawful('r.text')}) = 0 and len(list_filter({_list(P.BLOCKED)}, lambda w: contains(r.text, w))) = 0 and {_overclaimed('r.text').replace('ground2', 'r.ground2').replace('ground <', 'r.ground <').replace('(ground', '(r.ground').replace('then ground ', 'then r.ground ')} is null then {SCRUBBED.format('r.text')} end as text from p left join r on p.k = r.k""",
    view=True,
)
def _(t):
    return G.guard_comment(t.postings().select("k", F.col("story").alias("text"), "ground", "ground2"), "text", _grounds()).select("k", "text")


@query(
    "guard_draft_tail",
    f"""with f as (select k, story, title, list_concat({_facts('story', 'hay')}, {_claimed('story', 'source')}) as flags from (select *, {KEY.format('source')} as hay from p)),
l as (select *, {_dropped('story', 'flags')} as rest from f),
m as (select k, case when len(flags) = 0 then story when length(rest) >= greatest(40.0, length(story) / 3) then rest else title end as kept from l),
n as (select k, kept, list_filter({_list(P.BLOCKED)}, lambda w: contains(kept, w)) as bad from m),
o as (select k, {_dropped('kept', 'bad')} as clean from n)
select k, {SCRUBBED.format('clean')} as text from o""",
    view=True,
)
def _(t):
    return G.draft_tail(t.postings().select("k", F.col("story").alias("text"), "source", "title"), "text", F.array("source"), F.col("title")).select("k", "text")


@query("guard_safe_draft", "select k, title || '에 지원해요. ' || word || ' 경험이 있어요. 이 경험을 바탕으로 맡은 일을 성실히 해내고 싶어요.' as casual, 'Q' || k || '에 대해 말씀드리겠습니다. " + P.DRAFT["formal"][4] + "' as formal from p", view=True)
def _(t):
    one = F.array(F.concat(F.lit(" "), F.col("word"), F.lit(". ")), F.lit(" "))
    casual = G.safe_draft(F.lit("Q"), F.col("title"), one, "casual", F.lit(0))
    formal = G.safe_draft(F.concat(F.lit("Q"), F.col("k").cast("string")), F.lit(""), T.texts(), "formal", F.lit(0))
    return t.postings().select("k", casual.alias("casual"), formal.alias("formal"))


@query("split_cards", "select k, '0:' || word || '|2:' || seg as cards from p", view=True)
def _(t):
    xs = F.array(F.col("word"), F.concat(F.lit(P.EXCERPT), F.lit(" 글")), F.col("seg"))
    return t.postings().select("k", F.array_join(F.transform(G.split_cards(xs), lambda x: F.concat(x["at"].cast("string"), F.lit(":"), x["card"])), "|").alias("cards"))


@query("draft_length_rule", "select k, floor(c * (2.0::double / 3))::int as floor, c::int as ceiling, greatest(2, round_even(floor(c * (2.0::double / 3)) / 55, 0))::int as sentences from (select k, case when k % 1000 > 0 then k % 1000 else 600 end as c from p)", view=True)
def _(t):
    floor, ceiling, n = G.length_rule((F.col("k") % 1000).cast("int"))
    return t.postings().select("k", floor.alias("floor"), ceiling.cast("int").alias("ceiling"), n.alias("sentences"))


@query("grade_length", "select k, case when k % 3 = 0 then case when k % 1000 < 400 then 'short' when k % 1000 > 600 then 'long' else 'ok' end when k % 1000 > 500 then 'over' when k % 1000 < 500 * (2.0::double / 3) then 'under' else 'ok' end as grade from p", view=True)
def _(t):
    return t.postings().select("k", R.length(F.col("k") % 1000, F.when(F.col("k") % 3 == 0, 0).otherwise(500)).alias("grade"))


def _tokens(c: str) -> str:
    numbers = rf"list_filter(list_transform(regexp_extract_all({c}, '{P.NUMBER}'), lambda x: trim(x)), lambda x: length(regexp_replace(x, '\D', '', 'g')) >= 2)"
    return f"list_distinct(list_transform(list_concat({numbers}, regexp_extract_all({c}, '{P.LATIN}')), lambda x: {KEY.format('x')}))"


@query("sim_fact_jaccard", f"select conv_id, turn, case when len(x) + len(y) = 0 then 1.0 else round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) end::double as score from (select conv_id, turn, {_tokens('a')} as x, {_tokens('b')} as y from {TURN})")
def _(t):
    c = t("conversations").select("conv_id", "turn", "role", G.fact_tokens(F.col("text")).alias("x"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("x").alias("y"))
    return c.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("x"), F.col("y")), 9).alias("score"))


@query("tok_distinctive", "select k, lower(word) as first, lower(seg) as second, true as reflected from p", view=True)
def _(t):
    words = lambda c: F.array_distinct(F.transform(T.found_all(c, P.TOKEN), T.norm_key))
    p = t.postings().select("k", "word", "seg", words(F.concat_ws(" ", F.lit("공통"), "word")).alias("a"), words(F.concat_ws(" ", F.lit("공통"), "seg")).alias("b"))
    first, second = F.array_except("a", "b"), F.array_except("b", "a")
    reflected = F.exists(first, lambda x: F.contains(T.norm_key(F.concat(F.lit("이 "), F.col("word"), F.lit(" 경험"))), x))
    return p.select("k", F.array_join(first, "|").alias("first"), F.array_join(second, "|").alias("second"), F.when(F.size(first) > 0, reflected).alias("reflected"))


@query("card_rotate", "select k, seg || '|' || word || '|셋째|과거 자소서 발췌: 글' as cards from p", view=True)
def _(t):
    xs = F.array(F.col("word"), F.lit(P.EXCERPT + " 글"), F.col("seg"), F.lit("셋째"))
    is_card = lambda x: ~x.startswith(P.EXCERPT)
    cards = F.filter(xs, is_card)
    turned = F.when(F.size(cards) < 2, xs).otherwise(F.concat(F.slice(cards, 2, 1), F.slice(cards, 1, 1), F.filter(cards, lambda x, i: i >= 2), F.filter(xs, lambda x: ~is_card(x))))
    return t.postings().select("k", F.array_join(turned, "|").alias("cards"))


@query("eval_expectation", "select k, array_to_string(list_filter([case when asks > 0 and (asks > 1) <> contains(story, '백엔드') then 'strength' end, case when prefs > 0 and (prefs > 1) <> contains(story, '설계') then 'weakness' end, case when k % 3 = 2 and grade > 1 then 'noCall' end], lambda x: x is not null), '|') as misses from p", view=True)
def _(t):
    part = lambda w: F.regexp_extract("story", w, 0)
    want = {"strength": F.when(F.col("asks") > 0, F.col("asks") > 1), "weakness": F.when(F.col("prefs") > 0, F.col("prefs") > 1)}
    return t.postings().select("k", F.array_join(R.expectation(want, {"strength": part("백엔드"), "weakness": part("설계")}, F.col("k") % 3 == 2, F.col("grade") - 1), "|").alias("misses"))


@query("expand_tones", "select k, tone, attempt from p cross join (values ('formal', 1), ('confident', 1), ('casual', 1), ('casual', 2)) v(tone, attempt)", view=True)
def _(t):
    rows = t.postings().select("k")
    tones = rows.select("k", F.explode(T.texts("formal", "confident", "casual")).alias("tone"), F.lit(1).alias("attempt"))
    return tones.unionByName(rows.select("k", F.lit("casual").alias("tone"), F.lit(2).alias("attempt")))


@query("stub_draft", "select k, regexp_replace(left(repeat('" + P.STUB_SENTENCE + "', 30), case when k % 700 > 0 then k % 700 else 600 end::int), '\\s+$', '') as answer from p", view=True)
def _(t):
    limit = F.when(F.col("k") % 700 > 0, F.col("k") % 700).otherwise(600).cast("int")
    return t.postings().select("k", T.rstrip(F.left(F.repeat(F.lit(P.STUB_SENTENCE), F.floor(limit / len(P.STUB_SENTENCE)).cast("int") + 1), limit)).alias("answer"))


@query("stub_marker", "select k, case when k % 3 = 0 then 'empty' when k % 3 = 1 then 'rate_limited' end as marker from p", view=True)
def _(t):
    title = F.concat("title", F.when(F.col("k") % 3 == 0, " [stub:empty]").when(F.col("k") % 3 == 1, " [stub:rate_limited]").otherwise(""))
    return t.postings().select("k", F.nullif(F.regexp_extract(title, r"\[stub:(\w+)\]", 1), F.lit("")).alias("marker"))
