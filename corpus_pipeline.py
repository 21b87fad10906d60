"""From documents to a sharded training corpus in five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.

1. language: documents without a letter go, and those of which no language holds REJECT of the letters:
   texts in scripts that no learned language uses, and mixtures of many languages. The score is the main
   language's share of the letters, no measure of how well the text fits it.
2. near_duplicates: of each class of linked documents the one with the least id stays (of equal ids
   the one with the least hash of the text; a null id comes last).
3. decontamination: documents that hold half or more of a benchmark item go.
4. mixing: a document appears as often as the mix holds it (0, 1 or 2 times).
5. sharding: every row gets a shard and its place there.

Stages 2 to 4 decide per row, by id, text and, in stage 4, source: rows that share an id, or have none, do
not share a verdict. Of rows equal in id and text one stays in stage 2; given to stage 4 alone, rows equal
in all three share one number of repeats. Empty documents go in stage 1; an empty table passes all stages.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import decontaminate, jaccard, mixing, sharding
from framelake.llm import language as languages
from framelake.llm.common import cut, small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of a document's letters that its main language must hold.
REJECT = 0.35
#: SQL cannot express Viterbi spans or chosen paths; the stages are tested against plain versions.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = languages.identify(docs, languages.learn(docs), keep=("text", "lang", "source", "n_chars"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= REJECT)).select(COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """COLUMNS and _key: the id (nulls last) and a hash of the text, without nulls inside."""
    id = F.col("doc_id")
    some = F.coalesce(id, F.lit(0).cast(docs.schema["doc_id"].dataType))
    return docs.select(*COLUMNS, F.struct(id.isNull().alias("none"), some.alias("id"), F.xxhash64("text").alias("h")).alias("_key"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    gone = cut(jaccard.jaccard_join(rows, id="_key").where("class_id is not null and _key <> class_id").select("_key").distinct())
    kept = rows.join(small(gone), "_key", "left_anti")
    again = cut(rows.groupBy("_key").count().where("count > 1").select("_key"))
    if again.isEmpty():
        return kept.select(COLUMNS)
    once = kept.join(small(again), "_key", "left_semi").dropDuplicates(["_key"])
    return kept.join(small(again), "_key", "left_anti").unionByName(once).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = keyed(docs)
    leaks = cut(decontaminate.contaminated(rows, benchmark, id="_key").select("_key").distinct())
    return rows.join(small(leaks), "_key", "left_anti").select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    repeats = cut(mixing.mix(rows, id="_key").groupBy("_key", "source").agg(F.max("repeats").cast("int").alias("repeats")).where("repeats > 0"))
    # about as many rows as there are documents: always a shuffle, which hashes the slim side
    same = (F.col("d._key") == F.col("r._key")) & F.col("d.source").eqNullSafe(F.col("r.source"))
    held = rows.alias("d").join(repeats.alias("r").hint("shuffle_hash"), same).select("d.*", "r.repeats")
    return held.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; what one stage keeps is a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else cut(docs)
    return docs
