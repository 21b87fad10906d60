"""WARC archives: a distributed writer with revisit records, and a reader that verifies record boundaries.

The reader cuts files at the version line, so a file may be read in many splits at once. A piece
that follows a version line is only a candidate: its Content-Length names the offset at which its
successor must start. Tasks emit these record-to-successor offsets; pointer jumping from offset 0
of each file keeps the candidates that the chain reaches, so a version line inside a payload
never starts a record. Pieces between two true records belong to the first of them.

Defined results: a null payload is written as an empty one; a null or blank target has no
WARC-Target-URI; control characters and blanks in targets are percent-encoded; a null id has no
WARC-Page-ID and reads back as null; rows with equal payloads and the same largest id are all
responses; an empty table makes an archive without records, which reads back as no rows. A chain
that meets no valid record ends there: what follows in that file is no record, and `read_archives`
names the file, the offset and the number of bytes left. Payloads are text, so archives hold valid UTF-8; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, cut, new_path, small

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1: 160 bits are 8 groups of 20 bits, each 4 letters."""
    digest = F.sha1(payload)
    groups = [F.conv(F.substring(digest, 1 + 5 * g, 5), 16, 10).cast("int") for g in range(8)]
    return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(g, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for g in groups for k in range(4)))


def classified(pages: DataFrame, id: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """Adds _bytes, _digest and _refers: of equal payloads of `least_bytes` or more the one with the largest id is kept, the others refer to it."""
    rows = pages.withColumn("_payload", F.coalesce(F.col(payload).cast("string"), F.lit("")))
    rows = rows.withColumn("_bytes", F.octet_length("_payload").cast("long")).withColumn("_digest", base32_sha1(F.col("_payload").cast("binary")))
    kept = rows.where(F.col("_bytes") >= least_bytes).groupBy("_digest").agg(F.max(id).alias("_kept"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = attach(rows, cut(kept.select("_digest", "_kept")), ["_digest"], "left")  # payloads do not move where the table is small
    return rows.withColumn("_refers", F.when(F.col("_kept").isNotNull() & ~F.col("_kept").eqNullSafe(F.col(id)), F.col("_kept"))).drop("_kept")


def write_warc(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one record per row into the folder `path`, one WARC file per partition."""
    rows = classified(pages.select(F.col(id).alias("_id"), F.col(url).cast("string").alias("_url"), F.col(payload).alias("_body")), "_id", "_body", least_bytes)
    is_revisit = F.col("_refers").isNotNull()
    target = F.regexp_replace(F.regexp_replace("_url", r"^\s+|\s+$", ""), r"[\x00-\x20\x7f<>]", "%20")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("_payload")))
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(is_revisit, F.lit("revisit")).otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", F.coalesce(urn(F.col("_id")), F.lit("<urn:page:none>"))),
        F.lit(f"WARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\n"),
        line("WARC-Target-URI", F.when(F.length(target) > 0, target)),
        line("WARC-Page-ID", F.col("_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_digest")),
        line("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", urn(F.col("_refers"))),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block, F.lit("\r\n"),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n").text(path)  # the writer ends each record with the second line break


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between version lines, in file order within each split."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _offsets(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Adds `rel`, the offset of each piece after the start of the first piece of its split, in the order that the scan gives."""
    step = len(MAGIC)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple, int] = {}
        for batch in batches:
            rel = []
            for key, n in zip(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True), batch.column("len").to_pylist(), strict=True):
                rel.append(at.get(key, 0))
                at[key] = rel[-1] + n + step
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "block", "len", *extra)), pa.array(rel, pa.int64())], names=["file", "block", "len", *extra, "rel"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("file", "block", "len", *extra)) + ", rel long"
    return rows.select("file", "block", "len", *extra).mapInArrow(run, schema)


def _header(name: str, head: Column) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _jump(edges: DataFrame) -> DataFrame:
    """(file, at): the entries reached from offset 0 by following at -> exit; each round doubles the length of the jumps."""
    jumps, reached = cut(edges.select("file", "at", "exit")), None
    reached, n = cut(edges.where("at = 0").select("file", "at")), 0
    while (now := reached.count()) > n:
        n = now
        further = reached.join(jumps, ["file", "at"]).select("file", F.col("exit").alias("at"))
        reached = cut(reached.union(further).distinct())
        twice = jumps.alias("a").join(jumps.alias("b"), [F.col("a.file") == F.col("b.file"), F.col("a.exit") == F.col("b.at")])
        jumps = cut(twice.select("a.file", "a.at", F.col("b.exit").alias("exit")))
    return reached


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The true records: file, offset, record_type, record_id, target_uri, page_id, digest, refers_to, payload."""
    return read_archives(spark, path)[0]


def read_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The true records as `read_warc` gives them, and one row for each file whose chain does not end with the file: file, offset (where a valid record should start; beyond the file's end if the last record is cut off), left (bytes from there to the end, 0 or less if cut off)."""
    pieces = _pieces(spark, path)
    head = F.substring_index("value", END, 1)
    size = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*\r?$", 1)
    needs = F.when(F.col("value").contains(END) & (size != ""), F.octet_length(head) + size.cast("long") + 2 * len(END))
    slim = pieces.select("file", "block", F.octet_length("value").cast("long").alias("len"), needs.alias("needs"))
    heads = cut(_offsets(slim, ["needs"]))
    step = len(MAGIC)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = heads.groupBy("file", "block").agg(F.max(F.col("rel") + F.col("len") + step).alias("total"))
    blocks = blocks.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    # a piece's own version line starts `step` before the piece; the piece at offset 0 of a file has none
    cands = heads.join(blocks, ["file", "block"]).withColumn("at", F.col("base") + F.col("rel") - step).where("at >= 0 or len > 0 or needs is not null")
    cands = cut(cands.select("file", "block", "at", "len", (F.col("at") + step + F.col("needs")).alias("next"), (F.col("base") + F.col("total") - step).alias("stop")))

    def exits(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at", ascending=False)
        out: dict[int, int] = {}
        for at, nxt in zip(frame["at"], frame["next"], strict=True):
            if at >= 0 and nxt == nxt:
                out[at] = out.get(int(nxt), int(nxt))
        return pd.DataFrame({"file": keys[0], "block": keys[1], "at": list(out), "exit": list(out.values())}, columns=["file", "block", "at", "exit"])

    by_block = cands.select("file", "block", "at", F.col("next").cast("double").alias("next")).groupBy("file", "block")
    chains = cut(by_block.applyInPandas(exits, "file string, block long, at long, exit long"))
    landings = chains.select("file", F.col("exit").alias("at")).union(chains.where("at = 0").select("file", "at")).distinct()
    entries = _jump(chains.join(landings, ["file", "at"]))

    def walk(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        wanted = set(frame.loc[frame["entry"], "at"])
        hit = []
        for at, nxt in zip(frame["at"], frame["next"], strict=True):
            hit.append(at in wanted and nxt == nxt)
            if hit[-1]:
                wanted.add(int(nxt))
        return frame.assign(hit=hit)[["file", "block", "at", "hit"]]

    marked = cands.join(entries.withColumn("e", F.lit(True)), ["file", "at"], "left")
    marked = marked.select("file", "block", "at", F.col("next").cast("double").alias("next"), F.coalesce("e", F.lit(False)).alias("entry"))
    hits = cut(marked.groupBy("file", "block").applyInPandas(walk, "file string, block long, at long, hit boolean"))
    true = hits.where("hit").join(cands.select("file", "block", "at", "next"), ["file", "block", "at"]).groupBy("file").agg(F.max("next").alias("offset"))
    sizes = blocks.groupBy("file").agg((F.max(F.col("base") + F.col("total")) - step).alias("size"))
    errors = sizes.join(true, "file", "left").withColumn("offset", F.coalesce("offset", F.lit(0).cast("long"))).where("offset <> size").select("file", "offset", (F.col("size") - F.col("offset")).alias("left"))
    last = hits.where("hit").groupBy("file", "block").agg(F.max("at").alias("last"))
    carried = blocks.join(last, ["file", "block"], "left").withColumn("carry", F.max("last").over(before)).select("file", "block", "base", "carry")
    upto = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owners = hits.join(carried, ["file", "block"]).withColumn("owner", F.coalesce(F.last(F.when(F.col("hit"), F.col("at")), True).over(upto), "carry"))
    owners = owners.where("owner is not null").select("file", "block", (F.col("at") + step - F.col("base")).alias("rel"), "at", "owner")
    # a record that fills its piece needs no join; what is left are false candidates and records in several pieces
    own = cands.select("file", "block", "at", F.coalesce(F.col("next") == F.col("at") + step + F.col("len"), F.lit(False)).alias("fills"))
    odd = cut(owners.join(own, ["file", "block", "at"]).where(~((F.col("owner") == F.col("at")) & F.col("fills"))))
    ends = cands.select("file", F.col("at").alias("owner"), F.col("next").alias("upto"))
    odd = cut(odd.join(ends, ["file", "owner"]).withColumn("odd", F.col("at") < F.col("upto")))  # false: after the end of a broken chain
    full = _offsets(pieces.select("*", F.octet_length("value").cast("long").alias("len"), needs.alias("needs")), ["value", "needs"])
    full = full.join(small(cut(blocks.select("file", "block", "base"))), ["file", "block"])
    parts = full.join(small(odd.select("file", "block", "rel", "owner", "at", "odd")), ["file", "block", "rel"], "left")
    lost = cut(hits.join(owners.select("file", "block", "at"), ["file", "block", "at"], "left_anti").select("file", "block", "at"))  # before any true record
    if not lost.isEmpty():
        parts = parts.withColumn("at2", F.col("base") + F.col("rel") - step).join(lost.withColumnRenamed("at", "at2"), ["file", "block", "at2"], "left_anti")
    whole = parts.where("odd is null and needs = len").select("file", (F.col("base") + F.col("rel") - step).alias("owner"), "value")
    joined = parts.where("odd").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
    whole = whole.union(joined.select("file", "owner", F.array_join(F.transform("p", lambda x: x["value"]), MAGIC)))
    records = whole.withColumn("head", head).withColumn("body", F.substr("value", F.length("head") + len(END) + 1))
    payload = F.substr("body", F.instr("body", END) + len(END))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    found = records.select(
        "file", F.col("owner").alias("offset"), _header("WARC-Type", F.col("head")).alias("record_type"), _header("WARC-Record-ID", F.col("head")).alias("record_id"),
        _header("WARC-Target-URI", F.col("head")).alias("target_uri"), _header("WARC-Page-ID", F.col("head")).cast("long").alias("page_id"),
        F.regexp_replace(_header("WARC-Payload-Digest", F.col("head")), "^sha1:", "").alias("digest"),
        F.when(number(_header("WARC-Refers-To", F.col("head"))) != "", number(_header("WARC-Refers-To", F.col("head"))).cast("long")).alias("refers_to"),
        F.when(F.length(payload) >= len(END), F.substr(payload, F.lit(1), F.length(payload) - len(END))).otherwise("").alias("payload"),
    )
    return found, errors


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = read_warc(spark, path).select("page_id", "record_type", "digest", "refers_to", F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).alias("n"), F.when(F.col("record_type") == "response", base32_sha1(F.col("payload").cast("binary"))).alias("d"))
    records = cut(records)
    responses = records.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = cut(records.where("record_type = 'revisit'").select("page_id", "digest", "refers_to"))
    wanted = cut(revisits.select("refers_to", "digest").distinct())
    firsts = responses.alias("r").join(small(wanted).alias("w"), (F.col("r.page_id") == F.col("w.refers_to")) & (F.col("r.payload_digest") == F.col("w.digest")))
    firsts = cut(firsts.groupBy("w.refers_to", "w.digest").agg(F.first("payload_bytes").alias("payload_bytes")))
    revisits = attach(revisits, firsts, ["refers_to", "digest"]).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return responses.union(revisits)


OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS kept FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}', 1 + ((('0x' || substr(s, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = kept OR kept IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to
FROM d
"""
