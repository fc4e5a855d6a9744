"""Balanced label propagation: documents move to the shards of the documents they are linked with, under quotas.

Links are memberships (doc_id, hub): documents of one hub are linked with each other, without listing pairs. A hub
takes room in a shard when it is let in there as a whole; members of hubs not yet let in take none, since they leave.
Large hubs come first: there are at most LARGE of them a shard, so the driver packs them by falling size. Then rounds of
two joins: hubs count their members by shard and choose the shard that holds most of them (later a shard drawn by its
room), and each shard lets in what it has room for, larger ones first. Rounds go on until few hubs are left, which the
driver packs. Quotas are row counts, so that at the end the shards' counts are at most one apart: linked documents hold
their places first, unlinked ones fill up, and what is over a quota moves to the gaps of other shards.

Only a hub that fits nowhere is cut: it fills the roomiest shard, and its rest is packed like a hub of its own. Hubs are
cut between buckets of their rows' hashes, which are counted, so that no piece is over its room.

Places and quotas are found without a global sort: rows are counted by (shard, bucket of the hash), the buckets'
running sums give each bucket its first place, and rows are numbered inside their bucket only.

Null text counts as no bytes and is linked with empty text. Extra columns are not read. Repeated rows are rows
of their own when their doc_id differs. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hot_join, written

#: Rows that a bucket holds on average, the most that one window sorts.
BUCKET_ROWS = 20_000
#: Hash buckets by which hubs of about one size are let into a shard.
ADMIT = 4096
#: Hubs over 1 / LARGE of a quota are packed first; buckets by which a quota's worth of a hub is cut; hubs that the driver packs last.
LARGE, BUCKETS, LAST = 16, 256, 20_000


def packed(parts: dict[int, dict[int, int]], free: list[int]) -> list[tuple[int, int, int]]:
    """(hub, bucket, shard) of hubs given as rows by bucket; takes from free. Buckets that fit nowhere are left out."""
    heap = [(-sum(at.values()), hub, sorted(at.items())) for hub, at in parts.items()]
    heapq.heapify(heap)
    out = []
    while heap:
        size, hub, at = heapq.heappop(heap)
        fits = [s for s, room in enumerate(free) if room >= -size]
        s = min(fits, key=free.__getitem__) if fits else max(range(len(free)), key=free.__getitem__)
        rest = []
        for bucket, n in at:
            if n <= free[s]:
                free[s] -= n
                out.append((hub, bucket, s))
            else:
                rest.append((bucket, n))
        if rest and len(rest) < len(at):
            heapq.heappush(heap, (-sum(n for _, n in rest), hub, rest))
    return out


def _cut(linked: DataFrame, hubs: DataFrame, quota: int, free: list[int]) -> DataFrame:
    """(doc_id, shard) of the members of a few hubs (hub, hub_rows): at most BUCKETS rows a shard and one a hub come to the driver."""
    buckets = F.ceil(F.col("hub_rows") * F.lit(BUCKETS) / F.lit(quota))
    mine = linked.join(F.broadcast(hubs.select("hub", buckets.alias("_buckets"))), "hub")
    mine = mine.select("doc_id", "hub", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("_buckets")).alias("bucket"))
    parts: dict[int, dict[int, int]] = {}
    for r in mine.groupBy("hub", "bucket").agg(F.count("*").alias("n")).collect():
        parts.setdefault(r["hub"], {})[r["bucket"]] = r["n"]
    spark = linked.sparkSession
    to = spark.createDataFrame(packed(parts, free), "hub long, bucket long, shard int")
    return mine.join(F.broadcast(to), ["hub", "bucket"]).select("doc_id", "shard")


def propagate(nodes: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    """(doc_id, shard, slot) for every row of nodes (doc_id, unique); links are (doc_id, hub) with one hub (a long) a document."""
    spark = nodes.sparkSession
    total = nodes.count()
    quota = total // shards
    sizes = written(links.groupBy("hub").agg(F.count("*").alias("hub_rows")).where("hub_rows > 1"), "hubs")
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int").alias("start")
    linked = written(hot_join(links.select("doc_id", "hub"), sizes, "hub", "hub_rows", total, "inner").select("doc_id", "hub", "hub_rows", start), "linked")
    if not quota:
        return _placed(nodes, linked.select("doc_id", F.col("start").alias("shard")), shards, total)
    free = [quota + (s < total % shards) for s in range(shards)]
    large = F.col("hub_rows") > quota // LARGE
    done = [_cut(linked.where(large), sizes.where(large), quota, free)]
    small = linked.where(~large)
    held = small.groupBy("hub", "start").agg(F.count("*").alias("n"))
    most = F.max_by("start", F.struct("n", F.xxhash64("hub", "start"))).cast("int").alias("shard")
    left = written(held.groupBy("hub").agg(F.sum("n").alias("hub_rows"), most), "hubs-left")
    count, before, turn = left.count(), None, 0
    while count and (turn == 0 or LAST < count < before):
        room = F.element_at(F.array(*[F.lit(n).cast("long") for n in free]), F.col("shard") + 1)
        wish = left.withColumn("bucket", F.struct((-F.floor(F.log2("hub_rows"))).alias("size"), F.pmod(F.xxhash64("hub", F.lit(3 + turn)), F.lit(ADMIT)).alias("hash")))
        asked = wish.groupBy("shard", "bucket").agg(F.sum("hub_rows").alias("more"))
        upto = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        let_in = asked.withColumn("upto", F.sum("more").over(upto)).where(F.col("upto") <= room).select("shard", "bucket", F.lit(True).alias("_in"))
        tried = written(wish.join(let_in, ["shard", "bucket"], "left").select("hub", "hub_rows", "shard", F.col("_in").isNotNull().alias("_in")), "hubs-tried")
        moved = tried.where("_in")
        done.append(small.join(moved.select("hub", "shard"), "hub").select("doc_id", "shard"))
        for r in moved.groupBy("shard").agg(F.sum("hub_rows").alias("n")).collect():  # at most `shards` rows
            free[r["shard"]] -= r["n"]
        # Who was refused draws a shard, each with a chance in proportion to its room.
        turn += 1
        ends = list(accumulate(free))
        number = F.pmod(F.xxhash64("hub", F.lit(1000 + turn)), F.lit(max(1, ends[-1])))
        drawn = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= number)).cast("int")
        left = tried.where("not _in").select("hub", "hub_rows", F.least(drawn, F.lit(shards - 1)).alias("shard"))
        before, count = count, left.count()
    if count:
        last = left.orderBy(F.col("hub_rows").desc(), "hub").limit(LAST).select("hub", "hub_rows").collect()
        whole, rest = [], []
        for r in last:
            fits = [s for s, n in enumerate(free) if n >= r["hub_rows"]]
            if fits:
                s = min(fits, key=free.__getitem__)
                free[s] -= r["hub_rows"]
                whole.append((r["hub"], s))
            else:
                rest.append((r["hub"], r["hub_rows"]))
        to = spark.createDataFrame(whole, "hub long, shard int")
        done.append(small.join(F.broadcast(to), "hub").select("doc_id", "shard"))
        if rest:
            done.append(_cut(small, spark.createDataFrame(rest, "hub long, hub_rows long"), quota, free))
    return _placed(nodes, reduce(DataFrame.unionByName, done), shards, total)


def _placed(nodes: DataFrame, linked: DataFrame, shards: int, total: int) -> DataFrame:
    """Exact quotas: shard s gets total // shards rows, and one more if s < total % shards; slots are gapless."""
    buckets = max(4, -(-total // (BUCKET_ROWS * shards)))
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int")
    mark = nodes.select("doc_id").join(linked.select("doc_id", F.col("shard").alias("_to")), "doc_id", "left")
    # Linked documents come before the others, so that those over the quota are unlinked where there are any.
    bucket = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(buckets)) + F.when(F.col("_to").isNull(), buckets).otherwise(0)
    rows = written(mark.select("doc_id", F.coalesce("_to", start).alias("shard"), bucket.alias("bucket")), "shard-rows")
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = written(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "shard-counts")
    load = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # at most `shards` rows
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    over, gap, o, g = [], [], 0, 0
    for s in range(shards):
        n = load.get(s, 0)
        over.append(o)
        o += max(0, n - quota[s])
        if n < quota[s]:
            gap.append((s, n, g, g + quota[s] - n))
            g += quota[s] - n
    place = F.row_number().over(W.partitionBy("shard", "bucket").orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id")) - 1
    at = rows.join(counts.select("shard", "bucket", "first"), ["shard", "bucket"]).withColumn("place", (F.col("first") + place).cast("long"))
    of = lambda xs: F.element_at(F.array(*[F.lit(x).cast("long") for x in xs]), F.col("shard") + 1)
    extra = F.col("place") - of(quota)
    number = of(over) + extra
    to = F.lit(None).cast("struct<shard:int,slot:long>")
    for s, n, first, last in gap:
        to = F.when((number >= first) & (number < last), F.struct(F.lit(s).alias("shard"), (n + number - first).cast("long").alias("slot"))).otherwise(to)
    here = F.struct(F.col("shard"), F.col("place").alias("slot"))
    return at.select("doc_id", F.when(extra < 0, here).otherwise(to).alias("p")).select("doc_id", "p.shard", "p.slot")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Shards documents so that equal texts stay together and row counts are at most one apart.

    doc_id, size (UTF-8 bytes of the text and 16), text_crc32 (unsigned; null: that of no bytes), law (always
    ``rows``), shard, slot (from 0 in each shard, without gaps), grown_shard (null under this law).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = written(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.sha2(text, 256)).alias("hub"), F.monotonically_increasing_id().alias("row")), "shard-facts")
    own = facts.select(F.col("row").alias("doc_id"), "hub")  # doc_id may repeat or be null; the rows of the written table don't
    placed = propagate(own.select("doc_id"), own, shards).withColumnRenamed("doc_id", "row")
    return facts.join(placed, "row").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_edges(placed: DataFrame, links: DataFrame) -> DataFrame:
    """(hub, cut): of each hub of links (doc_id, hub), how many pairs of its members placed (doc_id, shard) has in different shards. Pairs are counted, not listed."""
    n = links.join(placed.select("doc_id", "shard"), "doc_id").groupBy("hub", "shard").agg(F.count("*").alias("n"))
    return n.groupBy("hub").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("cut"))
