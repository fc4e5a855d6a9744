"""Facts from announcements by rules: columns of text to structs and arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .patterns import U
from .text import bound, first_of, found, found_all, hit, lines, may_hold, parts, strip, sub, texts


def discriminatory(c: Column) -> Column:
    """The names of the categories of unlawful demands in the text, in their order."""
    return bound(c, lambda v: F.filter(F.array(*[F.when(hit(v, p), F.lit(name)) for name, p in P.DISCRIMINATORY.items()]), lambda x: x.isNotNull()))


# ---- Deadlines ----


def label_hits(c: Column) -> Column:
    """Every hit of every label: rank of the label, number of the hit, 1-based position."""

    def one(rank: int, label: str) -> Column:
        # The lengths between hits, summed up in one pass.
        gaps = F.transform(F.split(c, "\\Q" + label + "\\E", -1), F.length)
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))
        places = F.aggregate(gaps, start, lambda a, g: F.struct((a["at"] + g + len(label)).alias("at"), F.concat(a["out"], F.array(a["at"] + g)).alias("out")), lambda a: F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1))
        hits = F.transform(places, lambda at, i: F.struct(F.lit(rank).alias("rank"), (i + 1).alias("n"), at.alias("at")))
        return F.when(F.contains(c, F.lit(label)), hits).otherwise(F.array().cast("array<struct<rank:int,n:int,at:int>>"))

    return F.concat(*[one(i, w) for i, w in enumerate(P.DEADLINE_LABELS)])


def window(c: Column, at: Column) -> Column:
    """What follows a label: to the end of its block (of the next one, if its own has no digit), or to a word that begins another date."""
    def second(chunk: Column, first: Column) -> Column:
        rest = F.substring(chunk, first + 2, F.length(chunk))
        return bound(F.locate("\n\n", rest), lambda at_: F.when(at_ > 0, F.left(chunk, first + at_)).otherwise(chunk))

    def block(chunk: Column, first: Column) -> Column:
        own = F.left(chunk, first - 1)
        return F.when(first <= 1, chunk).when(own.rlike(r"\d"), own).otherwise(second(chunk, first))

    def cut(text: Column) -> Column:
        return bound(F.regexp_instr(F.substring(text, F.lit(2), F.length(text)), F.lit(U(P.WINDOW_END))), lambda stop: F.when(stop > 0, F.left(text, stop)).otherwise(text))

    return bound(F.substring(c, at, F.lit(P.WINDOW_CHARS)), lambda chunk: bound(bound(F.locate("\n\n", chunk), lambda first: block(chunk, first)), cut))


def matched(chunk: Column) -> Column:
    """What a window's dates are and what stands between them: one struct, so that each pattern runs once a window."""
    return F.struct(chunk.alias("chunk"), parts(chunk, P.DATE).alias("between"), *[found_all(chunk, P.DATE, i).alias(k) for i, k in enumerate(("whole", "year", "month", "day"))])


def dates(m: Column) -> Column:
    """The dates of a window (see :func:`matched`) that can be dates: year text, month, day, and the 12 characters that follow."""
    rows = F.arrays_zip(m["whole"], m["year"], m["month"], m["day"], m["between"])  # one more piece between than dates
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def place(a: Column, x: Column) -> Column:
        head = a["at"] + F.length(x["between"])
        tail = head + F.coalesce(F.length(x["whole"]), F.lit(0))
        return F.struct(tail.alias("at"), F.concat(a["out"], F.array(F.struct(head.alias("start"), tail.alias("end")))).alias("out"))

    def date(x: Column) -> Column:
        low = F.greatest(F.lit(0), x["at"]["start"] - 12)
        around = F.substring(m["chunk"], low + 1, x["at"]["end"] + 6 - low)
        return F.struct(x["year"].alias("year"), x["month"].cast("int").alias("month"), x["day"].cast("int").alias("day"), around.alias("around"), F.substring(m["chunk"], x["at"]["end"] + 1, F.lit(12)).alias("after"))

    placed = F.arrays_zip(m["year"], m["month"], m["day"], F.slice(F.aggregate(rows, start, place, lambda a: a["out"]), F.lit(1), F.size(m["whole"])).alias("at"))
    return F.filter(F.transform(F.when(F.size(m["whole"]) > 0, placed).otherwise(F.slice(placed, 1, 0)), date), lambda d: d["month"].between(1, 12) & d["day"].between(1, 31) & ~found(d["around"], P.NOT_DATE))


def due_candidates(c: Column, as_of: Column) -> Column:
    """One struct a hit whose window has a credible last date."""

    def dated(h: Column) -> Column:
        return F.struct(h["rank"].alias("rank"), h["n"].alias("n"), window(c, h["at"]).alias("chunk"), found(F.substring(c, F.greatest(F.lit(1), h["at"] - 8), F.least(F.lit(8), h["at"] - 1)), P.ROUND_BEFORE).alias("round"))

    def parted(h: Column) -> Column:
        return F.struct(h["rank"].alias("rank"), h["n"].alias("n"), h["round"].alias("round"), h["chunk"].alias("chunk"), matched(h["chunk"]).alias("m"))

    def read(h: Column) -> Column:
        return F.struct(h["rank"].alias("rank"), h["n"].alias("n"), h["round"].alias("round"), F.left(strip(h["chunk"]), F.lit(80)).alias("raw"), dates(h["m"]).alias("dates"))

    def resolved(h: Column) -> Column:
        last = F.element_at(h["dates"], -1)
        lent = F.try_element_at(F.filter(F.transform(F.slice(h["dates"], F.lit(1), F.size(h["dates"]) - 1), lambda d: d["year"]), lambda y: y != ""), F.lit(1))
        return bound(F.struct(last.alias("last"), F.coalesce(F.nullif(last["year"], F.lit("")), lent).alias("year")), lambda x: dated_by(h, x["last"], x["year"]))

    def dated_by(h: Column, last: Column, year: Column) -> Column:
        number = F.when(year.isNull(), F.year(as_of)).when(year.cast("int") < 100, year.cast("int") + 2000).otherwise(year.cast("int"))
        iso = F.try_to_date(F.format_string("%04d-%02d-%02d", number, last["month"], last["day"]), "yyyy-MM-dd")
        return F.struct(h["rank"].alias("rank"), h["n"].alias("n"), h["round"].alias("round"), iso.alias("iso"), h["raw"].alias("raw"), year.isNull().alias("year_inferred"), found(last["after"], P.TIME).alias("has_time"))

    hits = F.filter(F.transform(F.filter(F.transform(F.transform(label_hits(c), dated), parted), lambda h: F.size(h["m"]["whole"]) > 0), read), lambda h: F.size(h["dates"]) > 0)
    return F.filter(F.transform(hits, resolved), lambda h: h["iso"].isNotNull() & (h["iso"] <= F.date_add(as_of, P.MAX_AHEAD_DAYS)))


def due_date(candidates: Column, c: Column) -> Column:
    """The deadline from its candidates: of the first label that has any, its hits up to the first without a round, the latest."""
    rank = F.array_min(F.transform(candidates, lambda h: h["rank"]))
    own = F.filter(candidates, lambda h: h["rank"] == rank)
    last = F.coalesce(F.array_min(F.transform(F.filter(own, lambda h: ~h["round"]), lambda h: h["n"])), F.lit(2**31 - 1))
    best = F.array_max(F.transform(F.filter(own, lambda h: h["n"] <= last), lambda h: F.struct(h["iso"], -h["n"], h["raw"], h["year_inferred"], h["has_time"])))
    none = F.lit(None)
    yes = bound(best, lambda x: F.struct(x["iso"].alias("iso"), x["raw"].alias("raw"), x["year_inferred"].alias("year_inferred"), x["has_time"].alias("has_time"), none.cast("string").alias("reason")))
    no = F.struct(none.cast("date").alias("iso"), none.cast("string").alias("raw"), F.lit(False).alias("year_inferred"), F.lit(False).alias("has_time"), F.when(found(c, P.NO_DEADLINE), "no_deadline").otherwise("not_found").alias("reason"))
    return F.when(F.size(candidates) > 0, yes).otherwise(no)


# ---- Questions ----


def max_chars(c: Column) -> Column:
    pairs = F.arrays_zip(found_all(c, P.CHAR_LIMIT, 1).alias("n"), found_all(c, P.CHAR_LIMIT, 2).alias("bound"))
    first = lambda keep: F.try_element_at(F.transform(F.filter(pairs, keep), lambda x: x["n"].cast("int")), F.lit(1))
    return F.coalesce(first(lambda x: ~x["bound"].isin("", "이상")), first(lambda x: x["bound"] == ""))


def form_questions(c: Column) -> Column:
    """Numbered or bulleted requests for an answer: order, question, max_chars."""
    # The line's pattern asks for six characters of a question, so an extract of none is no hit; lines that are shorter can't hold one.
    read = F.transform(F.filter(lines(c), lambda x: F.length(x) > 6), lambda x: F.struct(x.alias("line"), F.regexp_extract(x, U(P.QUESTION_LINE), 1).alias("raw")))
    read = F.transform(F.filter(read, lambda x: F.length(x["raw"]) > 0), lambda x: F.struct(strip(x["raw"]).alias("q"), x["line"].alias("line")))
    asked = F.filter(read, lambda x: found(x["q"], P.QUESTION_HINT) & ~found(x["q"], P.QUESTION_NOT) & ~found(x["q"], P.SENSITIVE, "i") & (F.size(discriminatory(x["q"])) == 0))
    asked = F.transform(asked, lambda x: F.struct(x["q"].alias("q"), F.regexp_extract(x["line"], U(P.QUESTION_LINE), 2).alias("limit")))
    return F.transform(asked, lambda x, i: F.struct((i + 1).alias("order"), x["q"].alias("question"), F.coalesce(F.nullif(max_chars(x["limit"]), F.lit(0)), max_chars(x["q"])).alias("max_chars")))


# ---- Qualifications, preferences ----


def qualification_lines(c: Column) -> Column:
    """Lines that state who may apply: a heading and up to QUAL_LINES lines after it, until another section begins."""
    state = lambda budget, out: F.struct(budget.alias("budget"), out.alias("out"))

    def step(a: Column, x: Column) -> Column:
        heading = hit(x, P.QUAL_HEADING) & ~found(x, P.BULLET_LINE)
        more = F.concat(a["out"], F.array(x))
        return (
            F.when(F.length(x) == 0, a)
            .when((a["budget"] == 0) & ~heading, a)  # outside a section only a heading counts
            .when(found(x, P.SECTION_END), state(F.lit(0), a["out"]))
            .when(found(x, P.LINE_SKIP), a)
            .when(heading, state(F.lit(P.QUAL_LINES), more))
            .when(a["budget"] > 0, state(a["budget"] - 1, more))
            .otherwise(a)
        )

    return F.aggregate(F.transform(lines(c), strip), state(F.lit(0), F.array().cast("array<string>")), step, lambda a: a["out"])


def majors(rows: Column) -> Column:
    """The majors that lines ask for, one a line that asks for any."""
    about = F.filter(rows, lambda x: hit(x, P.MAJOR_ANY) & ~hit(x, P.MAJOR_FREE))
    labelled = F.transform(about, lambda x: F.struct(x.alias("line"), F.regexp_extract(x, U(P.MAJOR_LABEL), 1).alias("label")))
    named = F.transform(labelled, lambda x: F.when(F.length(x["label"]) > 0, sub(strip(x["label"]), r"[.,·]+$")).otherwise(first_of(x["line"], P.MAJOR_ASKED)))
    stopped = lambda n: F.exists(texts(*P.MAJOR_STOP), lambda w: F.contains(n, w))
    return F.filter(named, lambda n: n.isNotNull() & ~stopped(n) & ~found(n, P.MAJOR_GENERIC))


def qualifications(rows: Column) -> Column:
    """year, gpa, major from qualification lines: the first line that says it."""
    first = lambda f: F.try_element_at(F.filter(F.transform(rows, f), lambda v: v.isNotNull()), F.lit(1))
    gpa = lambda x: F.coalesce(*[F.when(may_hold(x, p), first_of(x, p)) for p in P.GPA])
    year = F.coalesce(first(lambda x: F.when(F.contains(x, F.lit("학년")), first_of(x, P.YEAR_GRADE))), first(lambda x: F.when(F.contains(x, F.lit("학기")), first_of(x, P.YEAR_SEMESTER))))
    return F.struct(year.alias("year"), first(gpa).alias("gpa"), F.try_element_at(majors(rows), F.lit(1)).alias("major"))


def preferences(c: Column) -> Column:
    """The items under the first heading of preferences, at most ten."""
    state = lambda open_, done, items: F.struct(open_.alias("open"), done.alias("done"), items.alias("items"))
    yes, no = F.lit(True), F.lit(False)

    def step(a: Column, x: Column) -> Column:
        item = strip(F.regexp_extract(x, U(P.PREFERENCE_ITEM), 1))
        blank = F.length(strip(x)) == 0
        more = F.when(F.size(discriminatory(item)) > 0, a["items"]).otherwise(F.concat(a["items"], F.array(item)))
        return (
            F.when(a["done"], a)
            .when(~a["open"], state((F.contains(x, F.lit("우대")) | F.contains(x, F.lit("가점"))) & found(x, P.PREFERENCE_HEADING), no, a["items"]))
            .when(blank, state(yes, F.size(a["items"]) > 0, a["items"]))
            .when(~found(x, P.PREFERENCE_ITEM), state(yes, yes, a["items"]))
            .otherwise(state(yes, F.size(more) >= P.MAX_KEYWORDS, more))
        )

    return F.aggregate(lines(c), state(no, no, F.array().cast("array<string>")), step, lambda a: a["items"])


# ---- Kind, signals ----


def guess_type(title: Column, c: Column) -> Column:
    count = lambda x, p: F.when(may_hold(x, p), F.regexp_count(x, F.lit(U(p)))).otherwise(0)
    scores = F.array(*[F.struct((count(title, p) * 5 + count(c, p)).alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, p) in enumerate(P.TYPE_HINTS.items())])
    best = F.array_max(scores)
    return F.when(best["score"] > 0, best["name"])


def signals(c: Column, has_deadline: Column, title: Column) -> Column:
    academic = found(title, P.ACADEMIC)
    first = lambda x, p: F.nullif(F.regexp_extract(x, U(p), 0), F.lit(""))
    fits, who = ~academic & hit(c, P.APPLICABLE), ~academic & hit(c, P.ELIGIBILITY)
    until = ~academic & has_deadline
    hits = F.when(academic, F.array(first(title, P.ACADEMIC))).otherwise(F.filter(F.array(first(c, P.APPLICABLE), first(c, P.ELIGIBILITY)), lambda x: x.isNotNull()))
    score = fits.cast("int") + who.cast("int") + until.cast("int")
    return F.struct(fits.alias("applicable"), who.alias("has_eligibility"), until.alias("has_deadline"), academic.alias("academic_admin"), hits.alias("hits"), score.alias("score"), (~academic & (score >= 2)).alias("likely_posting"))


# ---- The simple heuristic ----


def plain_type(c: Column) -> Column:
    has = lambda *ws: F.expr("false") if not ws else F.exists(texts(*ws), lambda w: F.contains(c, w))
    return F.when(has("장학"), "scholarship").when(has("공모전", "경진대회", "해커톤"), "contest").when(has("채용", "인턴", "정규직"), "recruit").when(has("대외활동", "서포터즈", "봉사"), "activity")


def plain_preferences(c: Column) -> Column:
    rows = F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n·•\-]", -1), strip)
    head = lambda x: x.endswith(":") | x.endswith("：") | found(x, r"\A우대\s?사항?[:：]?\z")
    return F.slice(F.filter(rows, lambda x: ~head(x) & F.contains(x, F.lit("우대")) & F.length(x).between(5, 100)), 1, 10)


def _valid(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")), "yyyy-MM-dd")


def plain_due(c: Column, as_of: Column) -> Column:
    full = F.arrays_zip(*[found_all(c, P.PLAIN_DATE, i).alias(k) for i, k in ((1, "y"), (2, "m"), (3, "d"))])
    last = F.try_element_at(F.filter(F.transform(full, lambda x: _valid(x["y"], x["m"], x["d"])), lambda x: x.isNotNull()), F.lit(-1))
    short = F.when(found(c, P.PLAIN_SHORT_DATE), _valid(F.year(as_of), F.regexp_extract(c, U(P.PLAIN_SHORT_DATE), 1), F.regexp_extract(c, U(P.PLAIN_SHORT_DATE), 2)))
    return F.when(~F.contains(c, F.lit("상시")), F.coalesce(last, short))


def plain_questions(c: Column) -> Column:
    get = lambda x, g: F.regexp_extract(x, U(P.PLAIN_QUESTION), g)
    read = F.transform(F.filter(lines(F.coalesce(c, F.lit(""))), lambda x: found(x, P.PLAIN_QUESTION)), lambda x: F.struct(get(x, 1).cast("int").alias("order"), strip(get(x, 2)).alias("question"), F.nullif(get(x, 3), F.lit("")).cast("int").alias("max_chars")))
    return F.slice(F.filter(read, lambda x: F.exists(texts(*P.PLAIN_CUES), lambda w: F.contains(x["question"], w))), 1, 10)


def plain_keywords(title: Column, c: Column) -> Column:
    """Up to ten words: five points a hit in the title, one in the text, two at least; ties by first appearance. One row's own words, no shuffle."""
    keep = lambda ws: F.filter(ws, lambda w: ~w.isin(*P.STOPWORDS))
    head, body = keep(found_all(F.coalesce(title, F.lit("")), P.WORD)), keep(found_all(F.coalesce(c, F.lit("")), P.WORD))
    points = F.transform(F.concat(F.transform(head, lambda w: F.struct(w.alias("w"), F.lit(5).alias("p"))), F.transform(body, lambda w: F.struct(w.alias("w"), F.lit(1).alias("p")))), lambda x, i: F.struct(x["w"].alias("w"), i.alias("at"), x["p"].alias("p")))
    # Sorted by word, equal words are neighbours, the first of them leading: each run is summed by itself.
    none = F.array().cast("array<int>")
    heads = lambda xs: F.filter(F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1)).otherwise(none), lambda i: (i == 0) | ~F.get(xs, i - 1)["w"].eqNullSafe(F.get(xs, i)["w"]))

    def summed(xs: Column, starts: Column) -> Column:
        runs = F.transform(starts, lambda b, j: F.slice(xs, b + 1, F.coalesce(F.get(starts, j + 1), F.size(xs)) - b))
        totals = F.transform(runs, lambda r: F.struct((-F.aggregate(r, F.lit(0), lambda a, x: a + x["p"])).alias("p"), F.get(r, F.lit(0))["at"].alias("at"), F.get(r, F.lit(0))["w"].alias("w")))
        return F.array_sort(F.filter(totals, lambda x: x["p"] <= -2))

    ranked = bound(F.array_sort(points), lambda xs: bound(heads(xs), lambda starts: summed(xs, starts)))
    return F.transform(F.slice(ranked, 1, P.MAX_KEYWORDS), lambda x: x["w"])
