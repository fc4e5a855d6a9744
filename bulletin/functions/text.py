"""Cleaning and measuring text, as functions from columns to columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .patterns import U


def sub(c: Column, pattern: str, to: str = "", flags: str = "") -> Column:
    return F.regexp_replace(c, F.lit(U(pattern, flags)), F.lit(to))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(P.WHITE))


def rstrip(c: Column) -> Column:
    return sub(c, r"\s+\z")


def found(c: Column, pattern: str, flags: str = "") -> Column:
    """Whether the pattern is anywhere in the text."""
    return c.rlike(U(pattern, flags))


def _closed(masked: str, at: int) -> int:
    """Where the bracket that opens at a place of a pattern is closed."""
    depth = 0
    for i in range(at, len(masked)):
        depth += (masked[i] == "(") - (masked[i] == ")")
        if not depth:
            return i
    return len(masked)


@lru_cache
def stems(pattern: str) -> tuple[str, ...]:
    """Plain words, one of which is in every text that the pattern matches; none if an alternative doesn't begin with one."""
    masked = re.sub(r"\\.|\[[^\]]*\]", lambda m: "\0" * len(m[0]), pattern)
    out: set[str] = set()
    at = 0
    while at <= len(masked):
        while masked.startswith(("(?<!", "(?!", "(?<="), at):
            at = _closed(masked, at) + 1
        if masked.startswith("(?:", at):
            end = _closed(masked, at)
            words = stems(pattern[at + 3 : end]) if masked[end + 1 : end + 2] not in ("?", "*", "{") else ()
        else:
            plain = re.match(r"[^\0()|?*+{}^$.]*", masked[at:])[0]
            words = (plain[:-1] if masked[at + len(plain) : at + len(plain) + 1] in ("?", "*", "{") else plain,)
        if not words or "" in words:
            return ()
        out.update(words)
        depth = 0
        while at < len(masked) and (depth or masked[at] != "|"):
            depth += (masked[at] == "(") - (masked[at] == ")")
            at += 1
        at += 1
    return tuple(sorted(x for x in out if not any(y != x and y in x for y in out)))


def may_hold(c: Column, pattern: str) -> Column:
    """False only where the pattern can't match: a search for plain words, which is cheaper than one for a pattern. c is evaluated once a word."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in stems(pattern)], F.lit(False)) if stems(pattern) else F.lit(True)


def hit(c: Column, pattern: str) -> Column:
    """As :func:`found`, for a c that costs nothing to read."""
    return may_hold(c, pattern) & found(c, pattern)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is evaluated once, however often use reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def found_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(U(pattern)), F.lit(group))


def first_of(c: Column, pattern: str, group: int = 0) -> Column:
    """The first hit's group, which isn't empty, without outer white space, else null."""
    return F.nullif(strip(F.regexp_extract(c, U(pattern), group)), F.lit(""))


def parts(c: Column, pattern: str) -> Column:
    return F.split(c, U(pattern), -1)


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def texts(*words: str) -> Column:
    """An array of literals, typed when empty."""
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def norm_key(c: Column) -> Column:
    return F.lower(sub(c, r"[\s,]"))


def squeezed(c: Column) -> Column:
    return F.lower(sub(c, r"\s"))


def normalize(c: Column) -> Column:
    c = F.replace(F.replace(sub(c, P.CONTROL), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = sub(sub(c, P.SPACES, " "), r"[\s&&[^\n]]+(?=\n|\z)")
    return strip(sub(c, r"\n{3,}", "\n\n"))


def is_flat(c: Column) -> Column:
    return F.regexp_count(c, F.lit("\n")) * P.FLAT_CHARS < F.length(c)


def resegment(c: Column) -> Column:
    return F.when(is_flat(c), sub(c, P.SEGMENT_BEFORE, "\n")).otherwise(c)


def strip_boilerplate(c: Column) -> Column:
    body = F.array_join(F.filter(lines(c), lambda x: ~found(x, P.BOARD_LINE, "i") & ~found(x, P.BOARD_META)), "\n")
    return strip(sub(body, P.TRAILER, "", "i"))


def strip_injections(c: Column) -> Column:
    """text: without instructions, gone: how many paragraphs or sentences went."""
    hit = lambda x: found(x, P.INJECTION, "i")

    def line(x: Column) -> Column:
        sentences = F.filter(parts(x, r"(?<=[.!?。])\s+"), lambda s: F.length(strip(s)) > 0)
        start = F.struct(F.lit(0).alias("skip"), F.lit(0).alias("gone"), F.array().cast("array<string>").alias("kept"))

        def step(a: Column, s: Column) -> Column:
            skipped = F.struct((a["skip"] - 1).alias("skip"), (a["gone"] + 1).alias("gone"), a["kept"].alias("kept"))
            begun = F.struct(F.lit(2).alias("skip"), (a["gone"] + 1).alias("gone"), a["kept"].alias("kept"))
            kept = F.struct(F.lit(0).alias("skip"), a["gone"].alias("gone"), F.concat(a["kept"], F.array(s)).alias("kept"))
            return F.when(a["skip"] > 0, skipped).when(hit(s), begun).otherwise(kept)

        return F.aggregate(sentences, start, step, lambda a: F.struct(F.array_join(a["kept"], " ").alias("text"), a["gone"].alias("gone")))

    # Each variant is one struct, so that the text and the count come from one evaluation; most texts hold no instruction and end at the first search.
    left = lambda xs: F.array_join(F.filter(F.transform(xs, lambda x: x["text"]), lambda t: F.length(strip(t)) > 3), "\n")
    whole = bound(F.transform(lines(c), line), lambda xs: F.struct(left(xs).alias("text"), F.aggregate(xs, F.lit(0), lambda a, x: a + x["gone"]).alias("gone")))
    clean = lambda ps: bound(F.filter(ps, lambda p: ~hit(p)), lambda own: F.struct(F.array_join(own, "\n\n").alias("text"), (F.size(ps) - F.size(own)).alias("gone")))
    kept = bound(F.split(c, "\n\n", -1), clean)
    several = F.contains(c, F.lit("\n\n"))
    return F.when(~hit(c), F.struct(c.alias("text"), F.lit(0).alias("gone"))).when(several, kept).otherwise(whole)


def mask_contacts(c: Column) -> tuple[Column, Column]:
    """The text with placeholders, and the number of contacts."""
    first = sub(c, P.EMAIL, P.MASK_EMAIL)
    second = sub(first, P.MOBILE, P.MASK_PHONE)
    count = lambda x, p: F.regexp_count(x, F.lit(U(p)))
    return sub(second, P.PHONE, P.MASK_PHONE), count(c, P.EMAIL) + count(first, P.MOBILE) + count(second, P.PHONE)


def truncate(c: Column, limit: int = P.MAX_CHARS) -> tuple[Column, Column]:
    head = F.left(c, F.lit(limit))
    at = F.locate("\n", F.reverse(head))
    cut = F.when(at > 0, limit - at).otherwise(-1)
    return F.when(F.length(c) <= limit, c).when(cut > limit // 2, F.left(head, cut)).otherwise(head), F.length(c) > limit


def too_short(c: Column) -> Column:
    return F.length(strip(c)) < P.MIN_CHARS


def sentences(c: Column) -> Column:
    return F.filter(F.transform(parts(c, r"(?<=[.!?。])\s+|\n+"), strip), lambda s: F.length(s) > 0)


def trim_to_limit(c: Column, limit: Column) -> Column:
    head = F.left(c, limit)
    whole = F.regexp_extract(head, U(r"\A.*[.!?。]\s*", "s"), 0)
    cut = F.when(F.length(whole) > F.floor(limit / 2), rstrip(whole)).otherwise(rstrip(head))
    return F.when((limit <= 0) | (F.length(c) <= limit), c).otherwise(cut)


def drop_sentences_with(c: Column, tokens: Column) -> Column:
    wanted = F.transform(F.filter(tokens, lambda t: F.length(t) > 0), norm_key)
    clean = lambda x: F.array_join(F.filter(parts(x, r"(?<=[.!?。])\s+"), lambda s: (F.length(strip(s)) > 0) & ~F.exists(wanted, lambda t: F.contains(norm_key(s), t))), " ")
    kept = F.array_join(F.transform(lines(c), clean), "\n")
    return F.when(F.size(tokens) == 0, c).otherwise(strip(sub(kept, r"\n{3,}", "\n\n")))


PII = f"{P.EMAIL}|{P.PHONE}|{P.MOBILE}|{P.RESIDENT}"


def scrub_pii(c: Column) -> tuple[Column, Column]:
    return sub(c, PII, P.SCRUBBED), F.regexp_count(c, F.lit(U(PII)))


def line_count(c: Column) -> Column:
    split = F.split(F.coalesce(c, F.lit("")), "[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]+", -1)
    return F.size(F.filter(split, lambda x: F.length(strip(x)) > 0))


def joined_nonempty(xs: Column, glue: str = ", ") -> Column:
    return F.array_join(F.filter(F.transform(xs, strip), lambda x: F.length(x) > 0), glue)


def posting_text(title: Column, keywords: Column) -> Column:
    return strip(F.concat(strip(title), F.lit("\n"), joined_nonempty(keywords)))


def render(template: Column, values: dict[str, Column]) -> Column:
    """{{name}} by value, in order; what is left over is an error."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{{" + k + "}}"), v)
    return F.when(template.rlike(r"\{\{[^{}]*\}\}"), F.raise_error(F.lit("a placeholder has no value"))).otherwise(template)


def count_phrases(c: Column, phrases: tuple[str, ...]) -> Column:
    compact = F.replace(c, F.lit(" "), F.lit(""))
    one = lambda p: F.floor((F.length(compact) - F.length(F.replace(compact, F.lit(p), F.lit("")))) / len(p))
    total = F.lit(0)
    for p in phrases:
        total = total + one(p.replace(" ", ""))
    return total.cast("long")


def ngrams(squeezed_text: Column, n: int = 3) -> Column:
    """Distinct n-grams of a text that is without white space already: a column of its own, since every n-gram reads it."""
    s = squeezed_text
    at = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(s, i, F.lit(n))))


def jaccard(x: Column, y: Column) -> Column:
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either == 0, 1.0).otherwise(both / either)


def sentence_overlap(a: Column, b: Column) -> Column:
    """The share of b's sentences that a has too, but for blanks and what stands after their last word; 0 without sentences."""
    keys = lambda c: F.transform(sentences(c), lambda s: norm_key(sub(s, P.TRAILING)))
    return bound(keys(a), lambda pool: bound(keys(b), lambda own: F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.filter(own, lambda s: F.array_contains(pool, s))) / F.size(own))))


def preprocessed(df: DataFrame, column: str) -> DataFrame:
    """df with pre_text and what was done to it, all stages in order. Each stage is a column, so that it is computed once."""
    count = lambda c, p: F.regexp_count(c, F.lit(U(p)))
    df = df.withColumn("_n", normalize(F.col(column))).withColumn("pre_resegmented", is_flat(F.col("_n"))).withColumn("_r", resegment(F.col("_n"))).withColumn("_b", strip_boilerplate(F.col("_r")))
    df = df.withColumn("_s", strip_injections(F.col("_b"))).withColumn("_t", F.col("_s.text")).withColumn("pre_injections", F.col("_s.gone"))
    mail = F.contains("_t", F.lit("@"))
    df = df.withColumn("_e", F.when(mail, sub(F.col("_t"), P.EMAIL, P.MASK_EMAIL)).otherwise(F.col("_t")))
    df = df.withColumn("_p", sub(F.col("_e"), P.MOBILE, P.MASK_PHONE))
    df = df.withColumn("_m", sub(F.col("_p"), P.PHONE, P.MASK_PHONE))
    # A replacement that changed nothing had nothing to count.
    masked = F.when(mail, count(F.col("_t"), P.EMAIL)).otherwise(0) + F.when(F.col("_p") != F.col("_e"), count(F.col("_e"), P.MOBILE)).otherwise(0) + F.when(F.col("_m") != F.col("_p"), count(F.col("_p"), P.PHONE)).otherwise(0)
    df = df.withColumn("pre_masked", masked)
    cut, over = truncate(F.col("_m"))
    return df.withColumns({"pre_text": cut, "pre_truncated": over}).drop("_n", "_r", "_b", "_s", "_t", "_e", "_p", "_m")
