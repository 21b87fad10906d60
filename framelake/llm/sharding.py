"""Balanced label propagation: shards of even size in which linked documents stand together.

Documents with equal texts are linked. A group of links starts dealt over all shards by a hash of
its ids. In each round every part of a group that is not the group's largest part in a shard with
room asks to move to that part. A shard grants as much as its quota leaves, those with most
neighbours there first; grants may take a share of a part. Rounds end when no part has a wish that a
shard has room for: every grant moves rows to a part of their group that is no smaller, so the number of
uncut pairs grows with each and the rounds come to an end. Documents without links have no wish and
fill what is left, so shard sizes differ by one row at most (the law `rows`).

A group is held as its counts per shard, never as pairs: a group of any size is one row, and
prefix sums over hash buckets turn counts into places, so no group meets in one task.

Defined results: a null text has size 0 (plus 1), crc32 of nothing (0) and forms one group with
the other nulls; an empty text is another text; rows with equal ids are separate rows; rows that
agree in id and text may change places with each other; an empty table gives no rows; fewer rows
than shards leave shards empty. Only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ranked, running

#: Rows of one group that meet their group's places under one key.
HOT_ROWS = 100_000


def propagate(groups: DataFrame, quota: list[int]) -> DataFrame:
    """g and a, the rows of each group in each shard, after the rounds of label propagation under quotas."""
    shards = len(quota)
    each = range(shards)
    while True:
        free = [max(0, q - n) for q, n in zip(quota, _loads(groups, shards), strict=True)]
        prefs = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct((-F.get("a", s)).alias("n"), F.pmod(F.xxhash64("g", s), F.lit(1 << 20)).alias("tie"), s.alias("s"))))
        room = F.array(*(F.lit(f > 0) for f in free))
        wish = groups.withColumn("prefs", prefs).withColumn("best", F.get(F.filter("prefs", lambda p: (p["n"] < 0) & F.get(room, p["s"])), F.lit(0)))
        asks = wish.where("best is not null").select("g", F.col("best.s").alias("to"), (-F.floor(F.log2(-F.col("best.n")))).cast("int").alias("level"), F.explode(F.filter("prefs", lambda p: (p["n"] < 0) & (F.struct(p["n"], p["tie"], p["s"]) > F.col("best")))).alias("p"))
        asks = cut(asks.select("g", "to", "level", F.col("p.s").alias("from"), (-F.col("p.n")).alias("n")))
        if asks.isEmpty():
            return groups
        granted = running(asks, ["to"], ["level"], [F.col("g"), F.col("from")], "n", "before")
        give = F.least(F.col("n"), F.get(F.array(*(F.lit(f) for f in free)), F.col("to")) - F.col("before"))
        granted = granted.withColumn("give", give).where("give > 0").groupBy("g").agg(F.first("to").alias("to"), F.sum("give").alias("sum"), F.map_from_entries(F.collect_list(F.struct("from", "give"))).alias("m"))
        moved = groups.join(granted, "g", "left")
        change = [F.coalesce(F.element_at("m", F.lit(s)), F.lit(0)) for s in each]
        groups = cut(moved.select("g", F.array(*(F.get("a", F.lit(s)) - change[s] + F.when(F.col("to") == s, F.col("sum")).otherwise(0) for s in each)).alias("a")))


def balanced_shards(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """Every row of `docs` with its shard and its place there: id, size, text_crc32, shard, slot."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("_t")).select(
        "id", (F.coalesce(F.octet_length("_t"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.col("_t").cast("binary")), F.lit(0)).cast("long").alias("crc"),
        F.unhex(F.coalesce(F.md5(F.concat(F.lit("t"), F.col("_t")).cast("binary")), F.md5(F.lit("null")))).alias("g"),
    )
    rows = cut(ranked(rows, ["g"], [F.col("id")], "r"))
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    each = range(shards)
    start = rows.withColumn("s", F.pmod(F.xxhash64(F.lit("start"), "id", "r"), F.lit(shards)).cast("int"))
    groups = start.groupBy("g", "s").count().groupBy("g").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("s", "count"))).alias("m")).where("n > 1")
    groups = cut(groups.select("g", F.array(*(F.coalesce(F.element_at("m", F.lit(s)), F.lit(0)) for s in each)).alias("a")))
    groups = propagate(groups, quota)
    # places: parts of groups first, the larger before the smaller; what exceeds the quota is let loose
    cells = groups.select("g", F.posexplode("a").alias("s", "n")).where("n > 0").withColumn("level", (-F.floor(F.log2("n"))).cast("int"))
    cells = running(cells, ["s"], ["level"], [F.col("g")], "n", "at")
    keep = F.greatest(F.lit(0), F.least(F.col("n"), F.get(F.array(*(F.lit(q) for q in quota)), F.col("s")) - F.col("at")))
    cells = cells.withColumn("keep", keep.cast("long")).where("keep > 0")
    held = {r["s"]: r["k"] for r in cells.groupBy("s").agg(F.sum("keep").alias("k")).collect()}
    ends = F.transform("c", lambda x, i: F.struct(x["s"].alias("s"), x["at"].alias("at"), F.aggregate(F.slice(F.col("c"), F.lit(1), i), F.lit(0).cast("long"), lambda acc, y: acc + y["keep"]).alias("from"), x["keep"].alias("keep")))
    places = cells.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("s", "at", "keep"))).alias("c")).select("g", ends.alias("c"))
    pieces = F.floor((F.aggregate("c", F.lit(0).cast("long"), lambda n, x: n + x["keep"]) - 1) / HOT_ROWS)
    places = cut(places.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces))))
    placed = rows.withColumn("piece", F.floor(F.col("r") / HOT_ROWS)).join(places, ["g", "piece"], "left")
    placed = placed.withColumn("p", F.get(F.filter("c", lambda x: (F.col("r") >= x["from"]) & (F.col("r") < x["from"] + x["keep"])), F.lit(0)))
    placed = cut(placed.select("id", "size", "crc", "r", F.col("p.s").alias("shard"), (F.col("p.at") + F.col("r") - F.col("p.from")).alias("slot")))
    loose = ranked(placed.where("shard is null").drop("shard", "slot"), [], [F.col("id"), F.col("crc"), F.col("r")], "q")
    where, slot, done = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in each:
        room = quota[s] - held.get(s, 0)
        where, slot = F.when((F.col("q") >= done) & (F.col("q") < done + room), s).otherwise(where), F.when((F.col("q") >= done) & (F.col("q") < done + room), F.col("q") - done + held.get(s, 0)).otherwise(slot)
        done += room
    filled = loose.select("id", "size", "crc", where.alias("shard"), slot.alias("slot"))
    out = placed.where("shard is not null").select("id", "size", "crc", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")).union(filled)
    return out.select(F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def _loads(groups: DataFrame, shards: int) -> list[int]:
    row = groups.agg(*(F.sum(F.get("a", F.lit(s))).alias(f"s{s}") for s in range(shards))).first()
    return [row[s] or 0 for s in range(shards)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards."""
    out = balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
