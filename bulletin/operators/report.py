"""Reports on generated texts: measures of every answer, and one row of figures a run."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import guard as G
from ..functions import patterns as P
from ..functions import text as T
from . import grade as R


def _share(hit: Column, of: Column | None = None) -> Column:
    """The share of rows that are a hit among those of a condition; null where there are none."""
    return F.avg((hit if of is None else F.when(of, hit)).cast("int"))


def reflects(answer: Column, marks: Column) -> Column:
    """Whether an answer holds any of a card's own tokens; null for a card without any."""
    return F.when(F.size(marks) > 0, F.exists(marks, lambda m: F.contains(T.norm_key(answer), m)))


def draft_measures(answers: DataFrame) -> DataFrame:
    """answers (run, id, slot: first, regen or rotated; tone, answer, limit, sources, forbidden, fallback, tokens, cost) with what is measured of each."""
    c, n = F.col("answer"), F.length("answer")
    rows = answers.withColumn("length_grade", R.length(n, F.col("limit"))).withColumn("fill_ratio", F.when(F.col("limit") > 0, F.round(n / F.nullif("limit", F.lit(0)), 2)))
    rows = rows.withColumn("_key", T.norm_key(c)).withColumn("n_forbidden", F.size(F.filter("forbidden", lambda w: (F.length(w) > 0) & F.contains(F.col("_key"), T.norm_key(w))))).drop("_key")
    return once(rows, ("answer", "sources", "tone"), _text_measures)


def _text_measures(rows: DataFrame) -> DataFrame:
    """answer, sources and tone with what they decide alone."""
    c, own = F.col("answer"), F.col("_own")
    rows = rows.withColumns({"_hay": G.haystack(F.col("sources")), "_own": T.sentences(c)})
    rows = rows.withColumn("n_unverified", F.size(F.array_distinct(F.concat(G.fact_check(c, F.col("sources"), F.col("_hay")), G.claims(c, F.col("sources"), own)))))
    ratio = G.ending_ratio(c, "formal", own)
    for t in [t for t in P.ENDINGS if t != "formal"]:
        ratio = F.when(F.col("tone") == t, G.ending_ratio(c, t, own)).otherwise(ratio)
    return rows.withColumns({"ending_ratio": ratio, "hedges": T.count_phrases(c, P.HEDGES), "cliches": T.count_phrases(c, P.CLICHES)}).drop("_hay", "_own")


def once(rows: DataFrame, keys: tuple[str, ...], measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the columns that measure adds to a table of their keys, each different key measured once: a join costs less than the rules. Null is a key like others; hashes only sort."""
    own = measure(rows.select(*keys).distinct()).withColumn("_hash", F.xxhash64(*keys)).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.col("_at") == F.col("_hash")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.withColumn("_at", F.xxhash64(*keys)).join(own, same).drop("_at", "_hash", *[f"_of_{k}" for k in keys])


#: N-grams and texts that :func:`_pairs_mean` lays out as one table of bits at most, but for a single text with more.
BLOCK_GRAMS, BLOCK_TEXTS = 1 << 14, 256


def _grams(texts: list[str], n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram of up to three letters as a number, and the place of its text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if len(codes) < n:
        return codes[:0], of[:0]
    whole = of[: len(of) - n + 1] == of[n - 1 :]
    grams = sum(codes[i : len(codes) - n + 1 + i] << (21 * i) for i in range(n))
    return grams[whole], of[: len(of) - n + 1][whole]


def _blocks(texts: list[str]) -> list[list[str]]:
    out, room = [], 0
    for t in texts:
        if not out or len(out[-1]) == BLOCK_TEXTS or len(t) > room:
            out.append([])
            room = BLOCK_GRAMS
        out[-1].append(t)
        room -= len(t)
    return out


def _pairs_mean(texts: list[str]) -> float:
    """The mean similarity of all pairs of texts by their distinct n-grams; 1 for two texts without any."""
    blocks = [(len(b), *_grams(b)) for b in _blocks(texts)]
    total = 0.0
    for k, (n, grams, of) in enumerate(blocks):
        known, at = np.unique(grams, return_inverse=True)
        one = np.zeros((n, len(known)), np.float32)
        one[of, at] = 1
        size = one.sum(axis=1, dtype=np.float64)
        for m, others, whose in blocks[k:]:
            if others is grams:
                two, sizes = one, size
            else:
                at = np.minimum(np.searchsorted(known, others), max(0, len(known) - 1))
                same = known[at] == others if len(known) else np.zeros(len(others), bool)
                two = np.zeros((m, len(known)), np.float32)
                two[whose[same], at[same]] = 1
                order = np.lexsort((others, whose))
                first = np.ones(len(order), bool)
                first[1:] = (np.diff(others[order]) != 0) | (np.diff(whose[order]) != 0)
                sizes = np.bincount(whose[order][first], minlength=m).astype(np.float64)
            both = (one @ two.T).astype(np.float64)
            either = size[:, None] + sizes[None, :] - both
            near = np.where(either > 0, both / np.maximum(either, 1), 1.0)
            total += near[np.triu_indices(n, 1)].sum() if others is grams else near.sum()
    return total / (len(texts) * (len(texts) - 1) / 2)


def cross_similarity(rows: DataFrame, run: str, text: str, name: str) -> DataFrame:
    """The mean n-gram similarity of all pairs of a run's texts; no row for a run with one.

    A run is one task's, text by text in a few bytes a letter: pairs are counted by products of its tables of bits, never laid out as rows.
    """
    kind = S.StructType([S.StructField(run, rows.schema[run].dataType), S.StructField(name, S.DoubleType())])

    def means(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds = None
        for r, group in groupby(((r, t, b.schema.field(0).type) for b in batches for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), key=itemgetter(0)):
            texts = []
            for _, t, kinds in group:
                texts.append(t)
            if len(texts) > 1:
                out.append((r, _pairs_mean(texts)))
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kinds), pa.array([x[1] for x in out], pa.float64())], [run, name])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kinds), pa.array([x[1] for x in out], pa.float64())], [run, name])

    return rows.select(run, text).repartition(run).sortWithinPartitions(run).mapInArrow(means, kind)


def _bare(c: str) -> Column:
    return T.sub(F.col(c), r"\s")


def _case_measures(case: DataFrame) -> DataFrame:
    """a, b and again with how near a is to b by facts and to again by n-grams and sentences."""
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    rows = case.withColumns({"_a": _bare("a"), "_again": _bare("again")}).withColumns({"_ga": T.ngrams(F.col("_a")), "_gagain": T.ngrams(F.col("_again"))})
    return rows.withColumns({
        "facts": F.when(both, T.jaccard(G.fact_tokens(F.col("a")), G.fact_tokens(F.col("b")))), "like": T.jaccard(F.col("_ga"), F.col("_gagain")), "copied": T.sentence_overlap(F.col("a"), F.col("again")),
    }).drop("_a", "_again", "_ga", "_gagain")


def draft_report(measured: DataFrame, tones: tuple[str, str]) -> DataFrame:
    """One row a run: of all first and repeated answers; of answers in both tones to one case; of a first answer and its repetition; of answers to different cases.

    measured may hold marks and rotated_marks, the first card's own tokens before and after cards were turned, on rows of the slots first and rotated.
    Pairs of cases are those of one run, in the first tone.
    """
    own = F.col("slot") != "rotated"
    limited = own & (F.col("limit") > 0)
    share = lambda hit, of: F.when(of, hit).cast("int")
    means = {
        "length_compliance": share(F.col("length_grade") != "over", limited), "fill_compliance": share(F.col("length_grade") == "ok", limited), "fill_ratio_mean": F.when(own, F.col("fill_ratio")),
        "default_range_compliance": share(F.col("length_grade") == "ok", own & (F.col("limit") == 0)), "fallback_rate": share(F.col("fallback"), own),
        **{f"tone_consistency_{t}": F.when(own & (F.col("tone") == t), F.col("ending_ratio")) for t in tones},
    }
    sums = {"forbidden_total": F.when(own, F.col("n_forbidden")), "unverified_total": F.when(own, F.col("n_unverified")), "hedges": F.when(own, F.col("hedges")), "cliches": F.when(own, F.col("cliches")), "total_tokens": F.col("tokens"), "cost_krw": F.col("cost")}
    at = lambda slot, tone, c: F.max(F.when((F.col("slot") == slot) & (F.col("tone") == tone), F.col(c)))
    # One pass over the answers: what a run adds up is added up by case first.
    case = measured.where(F.col("run").isNotNull()).groupBy("run", "id").agg(
        F.count("tokens").alias("calls"), *[F.sum(v).alias(k) for k, v in sums.items()], *[x for k, v in means.items() for x in (F.sum(v).alias(f"_sum_{k}"), F.count(v).alias(f"_n_{k}"))],
        at("first", tones[0], "answer").alias("a"), at("first", tones[1], "answer").alias("b"), at("first", tones[0], "ending_ratio").alias("ra"), at("first", tones[1], "ending_ratio").alias("rb"),
        at("regen", tones[0], "answer").alias("again"), (at("regen", tones[0], "fallback") | at("first", tones[0], "fallback")).alias("ruled"),
        at("rotated", tones[0], "answer").alias("rotated"), F.max(F.when(F.col("slot") == "first", F.col("marks"))).alias("marks"), F.max(F.when(F.col("slot") == "rotated", F.col("marks"))).alias("rotated_marks"),
    )
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    apart = (F.coalesce("ra", F.lit(0.0)) >= P.TONE_TARGET) & (F.coalesce("rb", F.lit(0.0)) >= P.TONE_TARGET)
    again = F.col("again").isNotNull() & ~F.col("ruled")
    case = once(case, ("a", "b", "again"), _case_measures).withColumns({"like": F.when(again, F.col("like")), "copied": F.when(again, F.col("copied"))})
    turned = F.col("rotated").isNotNull()
    follows = turned & F.coalesce(reflects(F.col("a"), F.col("marks")), F.lit(False)) & F.coalesce(reflects(F.col("rotated"), F.col("rotated_marks")), F.lit(False))
    mean = lambda k: (F.sum(f"_sum_{k}") / F.nullif(F.sum(f"_n_{k}"), F.lit(0))).alias(k)
    total = lambda k: F.sum(k).alias(k)
    rows = case.groupBy("run").agg(
        total("calls"), *[mean(k) for k in list(means)[:5]], total("forbidden_total"), total("unverified_total"), *[mean(k) for k in list(means)[5:]], total("hedges"), total("cliches"), total("total_tokens"), F.round(F.sum("cost_krw"), 4).alias("cost_krw"),
        F.count_if(both & apart).alias("distinguishable"), F.count_if(both).alias("distinguishable_of"), F.avg("facts").alias("fact_jaccard_mean"), F.avg("like").alias("regen_ngram_mean"),
        F.count_if(F.col("like") >= P.REGEN_SIMILAR).alias("regen_similar"), F.avg("copied").alias("regen_sentence_mean"), F.count_if(follows).alias("emphasis_follows"), F.count_if(turned).alias("emphasis_of"),
    )
    first = measured.where((F.col("slot") == "first") & (F.col("tone") == tones[0]) & F.col("answer").isNotNull() & F.col("run").isNotNull() & F.col("id").isNotNull())
    firsts = first.groupBy("run", "id").agg(F.max("answer").alias("a")).select("run", _bare("a").alias("a"))
    return rows.join(cross_similarity(firsts, "run", "a", "cross_case_ngram_mean"), "run", "left")


def comment_measures(cases: DataFrame) -> DataFrame:
    """cases (run, id, strength, weakness, grounds, forbidden, expect_strength, expect_weakness, no_call, tokens, cost) with what is measured of each."""
    said = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    strength, weakness = F.col("strength"), F.col("weakness")
    rows = cases.withColumn("text", F.array_join(F.filter(F.array(strength, weakness), said), "\n"))
    over = lambda c: F.when(said(c), F.size(T.sentences(c)) > P.MAX_SENTENCES).otherwise(F.lit(False))
    rows = rows.withColumns({"lines": T.line_count(strength) + T.line_count(weakness), "over": over(strength) | over(weakness), "_key": T.norm_key(F.col("text"))})
    wanted = {"strength": F.col("expect_strength"), "weakness": F.col("expect_weakness")}
    text = F.col("text")
    return rows.withColumns({
        "n_forbidden": F.size(F.filter("forbidden", lambda w: (F.length(w) > 0) & F.contains(F.col("_key"), T.norm_key(w)))),
        "n_unverified": F.when(F.length(text) > 0, F.size(G.fact_check(text, F.col("grounds")))).otherwise(0),
        "grounded": G.grounded(text, F.col("grounds")), "pii": T.found(text, T.PII), "silent": ~said(strength) & ~said(weakness),
        "misses": R.expectation(wanted, {"strength": strength, "weakness": weakness}, F.col("no_call"), F.coalesce("tokens", F.lit(0))),
    }).drop("_key")


def comment_report(measured: DataFrame) -> DataFrame:
    """One row a run."""
    called = F.coalesce(F.col("tokens"), F.lit(0)) > 0
    return measured.groupBy("run").agg(
        F.count_if(F.size("misses") == 0).alias("expect_ok"), F.count("*").alias("expect_of"), F.sum("n_forbidden").alias("forbidden_total"), F.sum("n_unverified").alias("unverified_total"),
        _share(F.col("grounded")).alias("grounded_rate"), F.count_if((F.col("lines") > P.MAX_LINES) | F.col("over")).alias("format_violations"), F.count_if("pii").alias("pii_total"),
        _share(F.col("silent"), called).alias("silent_rate"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(F.round(F.sum("cost"), 4), F.lit(0.0)).alias("cost_krw"),
    )


def record_grades(rows: DataFrame) -> DataFrame:
    """rows with labels (failed, reason, want_present, want_due, want_kind, want_questions, want_year, want_gpa, want_major, gold, gold_not, gold_preferences) and a pipeline's record
    (due_date, kind, n_questions, year, gpa, major, keywords, preferences, likely): a grade a fact, null where nothing is to be graded."""
    c = F.col
    graded = ~c("failed")
    lists = lambda gold, found, bad: F.when(graded & gold.isNotNull(), R.lists(gold, found, bad))
    quality = {f"grade_{f}": R.qualification(graded, c(f"want_{f}"), c(f)) for f in ("year", "gpa", "major")}
    return rows.withColumns({
        "grade_due": R.due(c("failed"), c("want_present"), c("want_due"), c("due_date")), "grade_type": R.kind(c("failed"), c("want_kind"), c("kind")),
        "grade_questions": R.questions(c("failed"), c("want_questions").isNotNull(), c("want_questions"), c("n_questions")), "grade_posting": R.posting(c("reason"), c("failed"), c("want_kind"), c("likely")),
        "grade_keywords": lists(c("gold"), c("keywords"), c("gold_not")), "grade_preferences": lists(c("gold_preferences"), c("preferences"), T.texts()), **quality,
    })


def record_report(graded: DataFrame) -> DataFrame:
    """All figures of one run as one row."""

    def accuracy(*names: str, hits: tuple[str, ...]) -> Column:
        some = [F.when(F.col(n).isNotNull() & (F.col(n) != "skip"), F.col(n).isin(*hits).cast("int")) for n in names]
        total = sum((F.sum(F.coalesce(s, F.lit(0))) for s in some), F.lit(0))
        return total / F.nullif(sum((F.count(s) for s in some), F.lit(0)), F.lit(0))

    sums = lambda g, f: F.sum(F.col(f"grade_{g}.{f}"))
    ratio = lambda g, a, b: sums(g, a) / F.nullif(sums(g, b), F.lit(0))
    quality = ("grade_year", "grade_gpa", "grade_major")
    right = ("correct", "correct_null")
    return graded.agg(
        F.count("*").alias("n"), accuracy("grade_due", hits=right).alias("due_accuracy"), accuracy("grade_type", hits=("correct",)).alias("type_accuracy"), accuracy("grade_questions", hits=("correct",)).alias("question_accuracy"),
        accuracy("grade_posting", hits=("correct",)).alias("posting_accuracy"), accuracy(*quality, hits=right).alias("qualification_accuracy"),
        sum((F.count_if(F.col(q) == "hallucinated") for q in quality), F.lit(0)).alias("qualification_hallucinated"), F.count_if(F.col("grade_due") == "hallucinated").alias("hallucinated"),
        ratio("keywords", "hit", "gold").alias("keyword_recall"), ratio("keywords", "pred_hit", "pred").alias("keyword_precision"), sums("keywords", "forbidden").alias("keyword_forbidden"),
        ratio("preferences", "hit", "gold").alias("preference_recall"), ratio("preferences", "pred_hit", "pred").alias("preference_precision"),
    )


def evaluated(postings: DataFrame, run) -> tuple[DataFrame, DataFrame]:
    """The graded rows and the report of any pipeline: run takes the labelled postings and returns them with the columns of a record."""
    graded = record_grades(run(postings))
    return graded, record_report(graded)


def answers(records: DataFrame) -> DataFrame:
    """(path, id, slot, answer) of the records of earlier runs (path, id, tones: map, regen, rotated): every answer once, where it was first recorded."""
    named = F.transform(F.map_entries("tones"), lambda e, i: F.struct(i.alias("at"), e["key"].alias("slot"), e["value"].alias("answer")))
    more = F.array(F.struct(F.lit(1000).alias("at"), F.lit("regen").alias("slot"), F.col("regen").alias("answer")), F.struct(F.lit(1001).alias("at"), F.lit("emphasis").alias("slot"), F.col("rotated").alias("answer")))
    rows = records.select("path", "id", F.explode(F.concat(named, more)).alias("x")).select("path", "id", "x.*").where("answer <> ''")
    first = rows.groupBy("answer").agg(F.min(F.struct("path", "id", "at", "slot")).alias("f"))
    return first.select("f.path", "f.id", "f.slot", "answer")
