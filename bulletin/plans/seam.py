"""Where an external model plugs in: a protocol, a deterministic local one, and the pipelines that call it."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guard as G
from ..functions import patterns as P
from ..functions import text as T
from ..operators import rank as R
from ..sources.scratch import written


class Provider(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class Transient(Exception):
    """A failure that is worth one more try."""


class RateLimited(Exception):
    """Refused for now; not asked again by a completion, waited for by an embedding."""


class TimedOut(Exception):
    """No answer in time."""


class InvalidInput(Exception):
    """A request that no try will make right."""


#: What a failure is called outside.
CODES = ((RateLimited, "RATE_LIMITED"), (TimedOut, "LLM_UNAVAILABLE"), (InvalidInput, "INVALID_INPUT"), (Transient, "LLM_UNAVAILABLE"))


class LocalProvider:
    """Answers with the longest words of what it is given, as JSON in a fence."""

    def complete(self, system: str, user: str) -> str:
        words = sorted(dict.fromkeys(user.split()), key=lambda w: (-len(w), w))[:5]
        return "```json\n" + json.dumps({"keywords": words}, ensure_ascii=False) + "\n```"


class LocalEmbedder:
    """A unit vector of hashed character pairs."""

    def embed(self, text: str, size: int = 16) -> list[float]:
        v = [0.0] * size
        for a, b in zip(text, text[1:]):
            v[hashlib.md5((a + b).encode()).digest()[0] % size] += 1.0
        return v


class LocalJudge:
    """Names the numbers of a draft as unsupported; an exclamation makes it forget the format."""

    def complete(self, system: str, user: str) -> str:
        draft = re.findall(r"^draft: (.*)$", user, re.M)[-1]
        return "no" if "!" in draft else json.dumps({"unsupported": sorted(set(re.findall("[0-9]+", draft)))})


class StubProvider(LocalProvider):
    """Fails as the marker [stub:...] in what it is given says."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def complete(self, system: str, user: str) -> str:
        marker = (re.findall(r"\[stub:(\w*)\]", user) or [""])[-1]
        again = user in self.seen
        self.seen[user] = 1
        if marker in ("rate_limited", "timeout", "input", "down") or marker == "transient" and not again:
            raise {"rate_limited": RateLimited, "timeout": TimedOut, "input": InvalidInput}.get(marker, Transient)(marker)
        return "no" if marker == "broken" or marker == "schema" and RETRY not in user else super().complete(system, user)


#: What is added to a request whose answer broke the format.
RETRY = "Answer with one JSON object only."


def parsed(answer: str) -> dict | None:
    """The object in an answer, if there is one."""
    first, last = answer.find("{"), answer.rfind("}")
    try:
        found = json.loads(answer[first : last + 1]) if 0 <= first < last else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def outcomes(requests: DataFrame, make: type = LocalProvider) -> DataFrame:
    """requests (key, system, user) with answer, code and calls; one provider a task.

    A transient failure is tried once more, a refused rate, a timeout or bad input never. An answer without an object is asked for once more, with a word on the format; then the code is SCHEMA.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()

        def ask(system: str, user: str) -> tuple[str | None, str | None, int]:
            calls = 0

            def call(text: str) -> str:
                nonlocal calls
                calls += 1
                try:
                    return provider.complete(system, text)
                except Transient:
                    calls += 1
                    return provider.complete(system, text)

            try:
                for text in (user, f"{user}\n\n{RETRY}"):
                    if parsed(answer := call(text)) is not None:
                        return answer, None, calls
                return None, "SCHEMA", calls
            except (RateLimited, TimedOut, InvalidInput, Transient) as failure:
                return None, next(code for kind, code in CODES if isinstance(failure, kind)), calls

        for b in batches:
            rows = [ask(s, u) for s, u in zip(b["system"], b["user"])]
            yield pd.DataFrame({"key": b["key"], "answer": [r[0] for r in rows], "code": [r[1] for r in rows], "calls": [r[2] for r in rows]})

    return requests.select("key", "system", "user").mapInPandas(run, "key string, answer string, code string, calls int")


def completed(requests: DataFrame, make: type = LocalProvider) -> DataFrame:
    """requests (key, system, user) with the answer, null where there is none."""
    return outcomes(requests, make).select("key", "answer")


def judged(drafts: DataFrame, make: type = LocalJudge) -> DataFrame:
    """drafts (key, title, question, evidence, draft) with flagged: what a judge calls unsupported; null where its answer broke the format."""
    evidence = F.when(F.size("evidence") > 0, F.array_join(F.transform("evidence", lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("(none)")
    user = T.render(F.lit("{{title}}\n{{question}}\n{{evidence}}\ndraft: {{draft}}"), {"title": F.col("title"), "question": F.col("question"), "evidence": evidence, "draft": F.regexp_replace("draft", "\n", " ")})
    answers = completed(drafts.select("key", F.lit("judge").alias("system"), user.alias("user")), make)
    found = F.from_json(G.extract_json(F.col("answer")), "unsupported array<string>")["unsupported"]
    return answers.select("key", F.when(F.col("answer").isNotNull(), F.coalesce(found, T.texts())).alias("flagged"))


def embedded(texts: DataFrame, make: type = LocalEmbedder, tries: int = 6, pause_s: float = 2.0) -> DataFrame:
    """texts (text, distinct) with vector; a refused rate is waited for, longer each time, a transient failure tried once more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()

        def embed(text: str) -> list[float]:
            failed = 0
            for n in range(tries):
                try:
                    return model.embed(text)
                except RateLimited:
                    time.sleep(pause_s * (n + 1))
                except Transient:
                    failed += 1
                    if failed > 1:
                        raise
            raise RateLimited(f"refused {tries} times")

        for b in batches:
            yield pd.DataFrame({"text": b["text"], "vector": [embed(x) for x in b["text"]]})

    return texts.select("text").mapInPandas(run, "text string, vector array<double>")


def field_similarity(postings: DataFrame, profile: Column) -> DataFrame:
    """postings (id, title, keywords) with similarity and score against a profile's text; each text is embedded once, blank ones not at all."""
    rows = postings.select("id", T.posting_text(F.col("title"), F.col("keywords")).alias("text"))
    vectors = embedded(rows.where("text <> ''").select("text").distinct())
    own = embedded(postings.sparkSession.range(1).select(profile.alias("text"))).select(F.col("vector").alias("own"))  # one row
    scored = vectors.crossJoin(own).select("text", F.round(R.cosine(F.col("vector"), F.col("own")), 4).alias("similarity"))
    return rows.join(scored, "text", "left").select("id", "similarity", F.coalesce(R.calibrate(F.col("similarity")), F.lit(0)).alias("score"))


def merged(postings: DataFrame, make: type = LocalProvider) -> DataFrame:
    """The record of rules and model together: rules win where they found something, failures carry a code; the model sees only what can be parsed, each request once."""
    from .rule_queries import rules

    r = rules(postings).withColumn("likely", F.col("signals.likely_posting"))
    ready = ~T.too_short(F.col("pre_text")) & F.col("likely")
    r = r.withColumn("user", F.when(ready, F.left("pre_text", F.lit(16_000)))).withColumn("key", F.sha2("user", 256)).withColumn("short", T.too_short(F.col("pre_text")))
    # Both sides of the join below read the record: written once, the rules run once.
    r = written(r.select("k", "due", "kind_found", "questions", "likely", "short", "user", "key"), "seam-record")
    asked = r.where("user is not null").select("key", F.lit("keywords").alias("system"), "user").dropDuplicates(["key"])
    answers = completed(asked, make).withColumn("keywords", F.from_json(G.extract_json(F.col("answer")), "keywords array<string>")["keywords"]).select("key", "keywords")
    out = r.join(answers, "key", "left").withColumn("keywords", G.keyword_hygiene(F.coalesce("keywords", T.texts())))
    code = G.failure_code(F.col("short"), F.lit(False), F.col("likely"), F.col("keywords"))
    out = out.withColumn("code", code)
    ok = F.col("code").isNull()
    return out.select("k", "code", F.when(ok, F.col("due.iso")).alias("due_date"), F.when(ok, F.coalesce("kind_found", F.lit("other"))).alias("kind"), F.when(ok, F.size("keywords")).otherwise(0).alias("n_keywords"), F.when(ok, F.size(F.slice("questions", 1, P.MAX_QUESTIONS))).otherwise(0).alias("n_questions"))
