"""Readers of announcement files, label and case files, prompts, and a sink for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

_FRONT = r"(?s)\A---\n(.*?)\n---\n(.*)\z"


def head_map(head: Column) -> Column:
    """The key: value lines of a front matter as a map of arrays; [a, b] is a list, quotes around a value go. The last of equal keys counts."""
    unquote = lambda v: F.regexp_replace(v, r"^[\"']+|[\"']+$", "")
    pairs = F.transform(F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("raw")))
    value = lambda r: F.when(r.rlike(r"(?s)^\[.*\]$"), F.filter(F.transform(F.split(F.substring(r, F.lit(2), F.length(r) - 2), ","), lambda x: unquote(strip(x))), lambda x: x != "")).otherwise(F.array(unquote(r)))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], value(x["raw"]))))


def front_matter(text: Column) -> tuple[Column, Column]:
    """Head and body of a file; without a front matter the head is null and the body is the whole."""
    has = text.rlike(_FRONT)
    return F.when(has, F.regexp_extract(text, _FRONT, 1)), F.when(has, strip(F.regexp_extract(text, _FRONT, 2))).otherwise(strip(text))


def read_postings(spark: SparkSession, path: str, skip_example: bool = True) -> DataFrame:
    """Announcement files below a folder, without read-me files, empty ones and (unless asked for) the example, in the order of their paths."""
    raw = spark.read.text(f"{path}/*.md", wholetext=True).withColumn("path", F.input_file_name())
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    kept = raw.withColumn("stem", stem).where((F.length("value") > 0) & (F.lower("stem") != "readme"))
    if skip_example:
        kept = kept.where(~F.col("stem").startswith("000"))
    head, body = front_matter(F.col("value"))
    return kept.select("path", "stem", head_map(F.coalesce(head, F.lit(""))).alias("head"), body.alias("body")).orderBy("path")


def read_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(f"{path}/*.json").withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def with_labels(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """Announcements with the label file of their stem, null where there is none."""
    return posts.join(labels, "stem", "left")


_DRAFT = "request struct<question:string,maxChars:int,postingTitle:string,keywords:array<string>,experienceSummaries:array<string>>, forbidden array<string>, emphasis boolean"
_COMMENT = "request struct<matchedKeywords:array<string>,matchedPreferences:array<string>,missingQualifications:array<string>,topExperienceTitle:string>, forbidden array<string>, expect map<string,boolean>"


def _read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(f"id string, note string, {schema}").option("multiLine", True).json(f"{path}/*.json").withColumn("path", F.input_file_name())
    none = F.array().cast("array<string>")
    return rows.withColumns({"id": F.coalesce("id", F.regexp_extract("path", r"([^/]+)\.json$", 1)), "note": F.coalesce("note", F.lit("")), "forbidden": F.coalesce("forbidden", none)})


def read_draft_cases(spark: SparkSession, path: str) -> DataFrame:
    """Draft cases below a folder, in the order of their paths: id (else the file's stem), note, request, forbidden (else none), emphasis (else not), path."""
    return _read_cases(spark, path, _DRAFT).withColumn("emphasis", F.coalesce("emphasis", F.lit(False))).orderBy("path")


def read_comment_cases(spark: SparkSession, path: str) -> DataFrame:
    """Comment cases below a folder, in the order of their paths: id, note, request, forbidden, expect (an absent key isn't graded), path, and grounds: all that a comment may cite."""
    rows = _read_cases(spark, path, _COMMENT).withColumn("expect", F.coalesce("expect", F.create_map().cast("map<string,boolean>")))
    many = [F.coalesce(F.col(f"request.{c}"), F.array().cast("array<string>")) for c in ("matchedKeywords", "matchedPreferences", "missingQualifications")]
    title = F.col("request.topExperienceTitle")
    return rows.withColumn("grounds", F.concat(*many, F.when(F.length(title) > 0, F.array(title)).otherwise(F.array().cast("array<string>")))).orderBy("path")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles one row each relevant posting: id, job_codes, tags, posting_id, grade."""
    schema = "profiles array<struct<id:string,jobCodes:array<string>,tags:array<string>,relevant:map<string,int>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("profiles").alias("p")).select("p.*")
    return rows.select("id", F.col("jobCodes").alias("job_codes"), "tags", F.explode_outer("relevant").alias("posting_id", "grade"))


def prompt_versions(files: DataFrame, pinned: dict[str, str] | None = None) -> DataFrame:
    """files (path, text) named name.vN.ext: the highest version of each name, or the pinned one."""
    rows = files.withColumn("name", F.regexp_extract("path", r"([^/]+)\.v\d+\.[^.]+$", 1)).withColumn("version", F.regexp_extract("path", r"\.v(\d+)\.[^.]+$", 1).try_cast("int")).where("version is not null")
    for name, version in (pinned or {}).items():
        rows = rows.where((F.col("name") != name) | (F.col("version") == int(version.removeprefix("v"))))
    return rows.groupBy("name").agg(F.max("version").alias("version"), F.max_by("path", "version").alias("path"), F.max_by("text", "version").alias("text"))


def write_report(report: DataFrame, path: str, run_id: str) -> None:
    """Appends a report under its run, as JSON."""
    report.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(path)
