"""Checks of generated text against its sources, as functions from columns to columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .extract import discriminatory
from .patterns import U
from .text import drop_sentences_with, found, found_all, norm_key, scrub_pii, sentences, strip, sub, texts, trim_to_limit


def extract_json(c: Column) -> Column:
    """The object in a model's answer as canonical text, or null: what a fence holds, from the first brace to the last."""
    fence = U(r"```(?:json)?\s*(.*?)```", "is")
    inner = F.when(c.rlike(fence), F.regexp_extract(c, fence, 1)).otherwise(c)
    first, last = F.locate("{", inner), F.length(inner) - F.locate("}", F.reverse(inner)) + 1
    body = F.when((first > 0) & (F.locate("}", inner) > 0) & (last >= first), F.substring(inner, first, last - first + 1))
    value = F.try_parse_json(body)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), F.to_json(value))


def haystack(sources: Column) -> Column:
    return norm_key(F.array_join(sources, " "))


def _any_in(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def _those_in(c: Column, words: tuple[str, ...]) -> Column:
    """The words that a text holds, in their order."""
    return F.when(_any_in(c, words), F.array_compact(F.array(*[F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in words]))).otherwise(texts())


def _may_overlap(a: str, b: str) -> bool:
    return a in b or b in a or any(x.endswith(y[:n]) for x, y in ((a, b), (b, a)) for n in range(1, min(len(a), len(b))))


def consumed_before(word: str, order: tuple[str, ...]) -> tuple[str, ...]:
    """Of the words that are taken out of a text before one, in order, those that decide whether it is still there: they share letters with it or with another of these."""
    own = [word]
    for w in reversed(order[: order.index(word)]):
        if any(_may_overlap(w, x) for x in own):
            own.insert(0, w)
    return tuple(own[:-1])


def spellings(c: Column, hay: Column) -> Column:
    """Spellings in the text that neither they nor their other form vouch for in the sources; longest first, each consumed once found."""
    table = sorted(P.SPELLINGS, key=lambda k: -len(k))
    order = (*P.NOT_SPELLINGS, *table)

    def unknown(k: str) -> Column:
        left = reduce(lambda x, w: F.replace(x, F.lit(w), F.lit(" ")), consumed_before(k, order), c)
        return F.when(F.contains(c, F.lit(k)) & F.contains(left, F.lit(k)) & ~_any_in(hay, (k, *P.SPELLINGS[k])), F.lit(k))

    return F.when(_any_in(c, tuple(table)), F.array_compact(F.array(*[unknown(k) for k in table]))).otherwise(texts())


def fact_check(c: Column, sources: Column, hay: Column | None = None) -> Column:
    """Numbers of two digits or more, Latin words and spellings that the sources don't have, in order, once each. hay: the sources' :func:`haystack` as a column, which is read many times."""
    hay = haystack(sources) if hay is None else hay
    digits = lambda t: sub(t, r"\D")
    numbers = F.filter(F.transform(found_all(c, P.NUMBER), strip), lambda t: (F.length(digits(t)) >= 2) & ~F.contains(hay, norm_key(t)) & ~F.contains(hay, digits(t)))
    other = F.create_map(*[F.lit(x) for k, vs in P.SPELLINGS.items() for v in vs for x in (v, k)])
    latin = F.filter(found_all(c, P.LATIN), lambda t: ~F.contains(hay, norm_key(t)) & ~F.coalesce(F.contains(hay, F.try_element_at(other, norm_key(t))), F.lit(False)))
    return F.array_distinct(F.concat(numbers, latin, spellings(c, hay)))


def fact_tokens(c: Column) -> Column:
    """Numbers of two digits or more and Latin words, as keys, once each."""
    numbers = F.filter(F.transform(found_all(c, P.NUMBER), strip), lambda x: F.length(sub(x, r"\D")) >= 2)
    return F.array_distinct(F.transform(F.concat(numbers, found_all(c, P.LATIN)), norm_key))


def final_of(ch: Column) -> Column:
    """Number of a Hangul syllable's final consonant, -1 for other characters."""
    code = F.ascii(ch) - 44032
    return F.when(code.between(0, 11171), code % 28).otherwise(-1)


#: Syllables that end in ㅆ, but for those of the present and the future.
_PAST = "".join(ch for ch in map(chr, range(44032 + 20, 44032 + 11172, 28)) if ch not in "있겠")


def past(c: Column) -> Column:
    return F.length(F.translate(c, _PAST, "")) < F.length(c)


def future(c: Column) -> Column:
    return found(c, P.FUTURE) | F.exists(found_all(c, P.ADNOMINAL, 1), lambda ch: final_of(ch) == 8)


def outcomes(c: Column, hay: Column, own: Column | None = None) -> Column:
    """Reactions and recognition that clauses in the past tense claim and the sources never speak of. own: the text's :func:`sentences` as a column."""
    free = [(words, ~found(hay, ground)) for words, ground in P.OUTCOMES.values()]
    every = tuple(w for words, _ in free for w in words)
    clauses = F.flatten(F.transform(sentences(c) if own is None else own, lambda s: F.split(s, ",", -1)))
    claimed = F.filter(clauses, lambda x: _any_in(x, every) & past(x) & ~future(x))
    found_in = lambda x: F.flatten(F.array(*[F.when(ok, _those_in(x, words)).otherwise(texts()) for words, ok in free]))
    some = reduce(lambda a, b: a | b, [_any_in(c, words) & ok for words, ok in free])
    return F.when(some, F.flatten(F.transform(claimed, found_in))).when(c.isNotNull(), texts())


def claims(c: Column, sources: Column, own: Column | None = None) -> Column:
    """Qualifications, prizes and employers that the text names and the sources don't, and :func:`outcomes`."""
    hay = F.array_join(sources, " ")
    named = [F.when(_any_in(hay, ws), texts()).otherwise(_those_in(c, ws)) for ws in P.CLAIMS.values()]
    return F.array_distinct(F.concat(*named, outcomes(c, hay, own)))


def blocked(c: Column, words: tuple[str, ...] = P.BLOCKED) -> Column:
    return F.filter(texts(*words), lambda w: F.contains(c, w))


def forbidden_hits(c: Column, words: Column) -> Column:
    return F.filter(words, lambda w: (F.length(w) > 0) & F.contains(norm_key(c), norm_key(w)))


def ending_ratio(c: Column, tone: str, own: Column | None = None) -> Column:
    """The share of sentences with a tone's ending before what stands after their last word. own: the text's :func:`sentences` as a column."""
    own = sentences(c) if own is None else own
    ending = P.ENDINGS.get(tone, P.ENDINGS["formal"]).removesuffix("$") + P.TRAILING.removesuffix("+$") + r"*\z"
    return F.size(F.filter(own, lambda s: found(s, ending))) / F.nullif(F.size(own), F.lit(0))


def cites(c: Column, ground: Column) -> Column:
    """Whether a text names a ground: as it stands, or half of its words."""
    compact, g = F.lower(F.replace(c, F.lit(" "), F.lit(""))), F.lower(F.replace(ground, F.lit(" "), F.lit("")))
    words = F.transform(found_all(ground, P.TOKEN), F.lower)
    return ((F.length(g) > 0) & F.contains(compact, g)) | ((F.size(words) > 0) & (F.size(F.filter(words, lambda w: F.contains(compact, w))) * 2 >= F.size(words)))


def _some(grounds: Column) -> Column:
    return F.filter(grounds, lambda g: F.length(g) > 0)


def keep_cited(c: Column, grounds: Column) -> Column:
    kept = F.filter(sentences(c), lambda s: F.exists(_some(grounds), lambda g: cites(s, g)))
    return F.when(F.size(kept) > 0, F.array_join(F.slice(kept, 1, P.MAX_SENTENCES), " "))


def grounded(c: Column, grounds: Column) -> Column:
    return F.when(F.length(c) > 0, F.forall(sentences(c), lambda s: F.exists(_some(grounds), lambda g: cites(s, g))))


def overclaimed(c: Column, grounds: Column) -> Column:
    """The first short ground that the text calls an ability, or null."""
    short = F.filter(F.transform(grounds, strip), lambda g: (F.length(g) > 0) & (F.length(g) <= P.SHORT_GROUND))
    return F.try_element_at(F.filter(short, lambda g: F.regexp(c, F.concat(F.lit("(?U)\\Q"), g, F.lit(r"\E\s*(?:관련\s*)?" + P.CAPABILITY)))), F.lit(1))


def keyword_hygiene(words: Column) -> Column:
    ok = F.filter(F.transform(words, strip), lambda w: (F.length(w) > 0) & (F.length(w) <= 40) & (F.size(discriminatory(w)) == 0))
    return F.slice(F.array_distinct(ok), 1, P.MAX_KEYWORDS)


def split_cards(xs: Column) -> Column:
    """Cards with their 0-based place in the whole list; excerpts are not cards."""
    return F.filter(F.transform(xs, lambda x, i: F.struct(i.alias("at"), x.alias("card"))), lambda x: ~x["card"].startswith(P.EXCERPT))


def length_rule(limit: Column) -> tuple[Column, Column, Column]:
    ceiling = F.when(limit > 0, limit).otherwise(P.DEFAULT_DRAFT)
    floor = F.floor(ceiling * (2 / 3)).cast("int")
    return floor, ceiling, F.greatest(F.lit(2), F.bround(floor / 55).cast("int"))


def failure_code(short: Column, has_images: Column, likely: Column, keywords: Column) -> Column:
    return F.when(short & has_images, "IMAGE_ONLY").when(short, "EMPTY").when(~likely, "NOT_A_POSTING").when(F.size(keywords) < P.MIN_KEYWORDS, "NO_KEYWORDS")


def safe_draft(question: Column, title: Column, cards: Column, tone: str, limit: Column) -> Column:
    """A draft from input strings alone, with at most three experiences."""
    with_title, without, suffix, tail, empty = P.DRAFT.get(tone, P.DRAFT["formal"])
    fill = lambda s: F.replace(F.replace(F.lit(s), F.lit("{title}"), title), F.lit("{question}"), question)
    head = F.when(F.length(title) > 0, fill(with_title)).otherwise(fill(without))
    used = F.filter(F.transform(F.slice(cards, 1, 3), strip), lambda x: F.length(x) > 0)
    body = F.transform(used, lambda x: F.concat(sub(x, r"\.+\z"), F.lit(" " + suffix)))
    any_card = F.exists(cards, lambda x: F.length(strip(x)) > 0)
    words = F.concat(F.array(head), F.when(F.size(body) > 0, body).otherwise(texts(empty)), F.when(any_card, texts(tail)).otherwise(texts()))
    return trim_to_limit(F.array_join(words, " "), limit)


def draft_tail(df: DataFrame, column: str, sources: Column, safe: Column) -> DataFrame:
    """df with column as what is left of a draft after its unverified sentences go, or the safe draft if too little is; without blocked words and contacts.

    Each step is a column of its own, since the next reads it more than once.
    """
    c = F.col(column)
    df = df.withColumn("_flagged", F.array_distinct(F.concat(fact_check(c, sources), claims(c, sources))))
    df = df.withColumn("_left", drop_sentences_with(c, F.col("_flagged")))
    enough = F.length("_left") >= F.greatest(F.lit(40.0), F.length(c) / 3)
    df = df.withColumn("_kept", F.when(F.size("_flagged") == 0, c).when(enough, F.col("_left")).otherwise(safe))
    df = df.withColumn("_bad", blocked(F.col("_kept"))).withColumn("_clean", drop_sentences_with(F.col("_kept"), F.col("_bad")))
    return df.withColumn(column, scrub_pii(F.col("_clean"))[0]).drop("_flagged", "_left", "_kept", "_bad", "_clean")


def guard_comment(df: DataFrame, column: str, grounds: Column) -> DataFrame:
    """df with column as a comment that survives: cited sentences only, no unverified ones, nothing unlawful, blocked or overclaimed, no contacts."""
    df = df.withColumn("_cited", keep_cited(F.col(column), grounds))
    df = df.withColumn("_flagged", F.array_distinct(F.concat(fact_check(F.col("_cited"), grounds), claims(F.col("_cited"), grounds))))
    df = df.withColumn("_left", drop_sentences_with(F.col("_cited"), F.col("_flagged"))).withColumn("_clean", keep_cited(F.col("_left"), grounds))
    c = F.col("_clean")
    bad = (F.size(discriminatory(c)) > 0) | (F.size(blocked(c)) > 0) | overclaimed(c, grounds).isNotNull()
    return df.withColumn("_bad", bad).withColumn(column, F.when(~F.col("_bad"), scrub_pii(c)[0])).drop("_cited", "_flagged", "_left", "_clean", "_bad")
