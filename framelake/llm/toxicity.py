"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a seed lexicon and of a learned lexicon (whole words and
five-letter beginnings), the densest window, lexicon words near second-person words, capitals,
punctuation, and obfuscated spellings (digits or signs for letters).

Learning takes a bounded sample: up to half of `sample` labelled documents of each class, so that a
rare class is learned from all its labels. Within each class the sample is dealt into four parts by
rank, two for the lexicon, one for the trees, one for the calibration; a class too small to have a
document in each is used whole for each. The calibration weighs rows by how many of their class were
left out, so scores stand for the shares among all labels.

Defined results: a null or empty text has all features 0 and is scored like any other; equal
texts get equal scores; rows are neither merged nor dropped; labels without a text, texts
without a label and labels of null are not learned from; with labels of one class only, or with
none, the score is the share of toxic labels (0 without labels). Only (id, text) go in, so other
columns of the input, whatever their names, have no influence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, cut, pieces, small

SEED = "idiot idiots moron morons stupid dumb scum trash loser losers worthless pathetic disgusting clown freak imbecile vermin filth garbage ugly bastard dumbass jerk pig swine cretin".split()
YOU = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split()
FEATURES = ["words", "seed", "learned", "starts", "weight", "window", "near_you", "you", "capitals", "all_caps", "punct", "bangs", "obfuscated", "word_length"]
#: Words on either side in which a second-person word counts as near; words of a window.
NEAR, WINDOW = 5, 25
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _fold() -> np.ndarray:
    fold = np.arange(0x110000, dtype=np.uint32)
    for a, b in LEET.items():
        fold[ord(a)] = ord(b)
    return fold


_FOLD: list[np.ndarray] = []


def _words(texts: list[str]) -> Words:
    if not _FOLD:
        _FOLD.append(_fold())
    return Words(texts, fold=_FOLD[0])


def _hashes(words: list[str]) -> np.ndarray:
    return np.unique(_words(words).hash) if words else np.zeros(0, np.uint64)


def _starts(w: Words) -> np.ndarray:
    return w.span_hash(w.start, np.minimum(w.end, w.start + 5)) ^ np.uint64(0x5BD1E995)


def _lookup(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h), np.float32)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], np.float32(0))


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def features(docs: DataFrame, id: str, text: str, lexicon: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], keep: list[str] = ()) -> DataFrame:
    """The dense features of every text: id, keep..., FEATURES as doubles."""
    learned_words = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), *keep)
    kept = ["_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, start_keys, start_values = learned_words.value
        seed, you = _hashes(SEED), _hashes(YOU)
        for batch in batches:
            for first, texts in pieces(batch, "_text"):
                w = _words(texts)
                b, n = w.bounds, np.maximum(np.diff(w.bounds), 1)
                is_seed = np.isin(w.hash, seed)
                learned, starts = _lookup(keys, values, w.hash), _lookup(start_keys, start_values, _starts(w))
                bad = is_seed | (learned > 0) | (starts > 0)
                is_you = np.isin(w.hash, you)
                doc = np.repeat(np.arange(len(texts)), np.diff(b))
                lo, hi = np.maximum(np.arange(len(doc)) - NEAR, b[doc]), np.minimum(np.arange(len(doc)) + NEAR + 1, b[doc + 1])
                yous = np.concatenate([[0], np.cumsum(is_you)])
                near = bad & (yous[hi] > yous[lo])
                bads = np.concatenate([[0], np.cumsum(bad)])
                dense = bads[np.minimum(np.arange(len(doc)) + WINDOW, b[doc + 1])] - bads[:-1] if len(doc) else np.zeros(0)
                window = np.zeros(len(texts))
                np.maximum.at(window, doc, dense)
                swapped = np.concatenate([[0], np.cumsum(w.points != w.folded)])
                obfuscated = bad & (swapped[w.end] > swapped[w.start])
                chars = np.array([max(len(t), 1) for t in texts], float)
                ascii_caps = np.array([sum(map(t.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for t in texts], float)
                columns = {
                    "words": np.log1p(np.diff(b)),
                    "seed": _sums(is_seed, b) / n,
                    "learned": _sums(learned > 0, b) / n,
                    "starts": _sums(starts > 0, b) / n,
                    "weight": _sums(np.maximum(learned, starts), b) / n,
                    "window": window,
                    "near_you": _sums(near, b) / n,
                    "you": _sums(is_you, b) / n,
                    "capitals": ascii_caps / chars,
                    "all_caps": np.array([sum(x.isupper() for x in t.split()) if u > 2 else 0 for t, u in zip(texts, ascii_caps, strict=True)]) / n,
                    "punct": np.array([sum(map(t.count, ".,;:!?*%&#$")) for t in texts]) / chars,
                    "bangs": np.array([t.count("!") + t.count("?") for t in texts]) / chars,
                    "obfuscated": _sums(obfuscated, b) / n,
                    "word_length": _sums(w.end - w.start, b) / n,
                }
                left = [batch.column(c).slice(first, len(texts)) for c in kept]
                yield pa.RecordBatch.from_arrays([*left, *(pa.array(np.asarray(columns[c], float)) for c in FEATURES)], names=[*kept, *FEATURES])

    schema = ", ".join([*(f"`{c}` {dict(rows.dtypes)[c]}" for c in kept), *(f"{c} double" for c in FEATURES)])
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id)


def learn_lexicon(train: DataFrame, text: str, label: str, least: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and five-letter word beginnings that mark label 1, with smoothed log odds of document frequencies.

    Counts cover all of `train`, which is a bounded sample; all words with enough evidence are kept.
    """
    rows = train.select(F.col(text).alias("_text"), F.col(label).cast("int").alias("_label"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column("_label").to_pylist())
            for first, texts in pieces(batch, "_text"):
                w = _words(texts)
                doc = np.repeat(np.arange(len(texts)), np.diff(w.bounds))
                for kind, h in ((0, w.hash), (1, _starts(w))):
                    pairs = np.unique(np.stack([h, doc.astype(np.uint64)]), axis=1)
                    toxic = labels[first + pairs[1].astype(int)] if len(doc) else np.zeros(0)
                    keys, at = np.unique(pairs[0], return_inverse=True)
                    bad, all_ = np.bincount(at, toxic, len(keys)), np.bincount(at, minlength=len(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(bad.astype(np.int64)), pa.array((all_ - bad).astype(np.int64))], names=["kind", "h", "bad", "good"])

    n = rows.groupBy().agg(F.sum("_label").alias("b"), F.count(F.lit(1)).alias("n")).first()
    bad_docs, good_docs = (n["b"] or 0), n["n"] - (n["b"] or 0)
    found = rows.mapInArrow(count, "kind int, h long, bad long, good long").groupBy("kind", "h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / F.lit(bad_docs + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(good_docs + 1.0))
    found = found.where((F.col("bad") >= least) & (F.col("bad") > F.col("good"))).withColumn("odds", odds).where("odds > 2")
    best = found.select("kind", "h", "odds").toArrow()
    kinds, keys, odds = (best.column(c).to_numpy() for c in ("kind", "h", "odds"))
    out = []
    for kind in (0, 1):
        own = keys[kinds == kind].astype(np.int64).view(np.uint64)
        order = np.argsort(own)
        out += [own[order], odds[kinds == kind].astype(np.float32)[order]]
    return tuple(out)


def score(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", may_learn: Column | None = None, sample: int = 24_000, trees: int = 30, depth: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores every text of `docs`: id, keep..., score (0 to 1), predicted (1 from 0.5).

    Labels are learned only from ids for which `may_learn` holds. The learners fit on a sample of
    about `sample` labelled rows, drawn by a hash of the id, which is sent to the texts. All rows are
    scored in one pass over `docs` without a shuffle.
    """
    usable = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1))
    if may_learn is not None:
        usable = usable.withColumnRenamed("_id", id).where(may_learn).withColumnRenamed(id, "_id")
    texts = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    share = {r["_label"]: min(1.0, sample / 2 / r["count"]) for r in usable.groupBy("_label").count().collect()}
    of_class = lambda f: F.when(F.col("_label") == 1, f(share.get(1, 1.0))).otherwise(f(share.get(0, 1.0)))
    drawn = usable.where(F.pmod(F.xxhash64(F.lit("toxicity"), "_id"), F.lit(1_000_000)) < of_class(lambda x: 1_000_000 * x))
    rank = F.row_number().over(Window.partitionBy("_label").orderBy(F.xxhash64(F.lit("part"), "_id"), "_id"))
    drawn = cut(drawn.withColumn("_part", F.pmod(rank, F.lit(4))).withColumn("_weight", of_class(lambda x: 1 / x)))
    train = cut(texts.join(small(drawn), "_id").select("_id", "_text", "_label", "_part", "_weight"))
    held = {(r["_label"], r["_part"]): r["count"] for r in train.groupBy("_label", "_part").count().collect()}
    good, bad = (sum(n for (k, _), n in held.items() if k == label) for label in (0, 1))
    if not (good and bad):
        out = docs.select(id, *keep).withColumn("score", F.lit(float(bad) / max(good + bad, 1)))
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    few = [k for k in (0, 1) if not ((held.get((k, 0)) or held.get((k, 1))) and held.get((k, 2)) and held.get((k, 3)))]
    of = lambda *parts: F.col("_part").isin(*parts) | F.col("_label").isin(few)
    lexicon = learn_lexicon(train.where(of(0, 1)), "_text", "_label")
    pack = VectorAssembler(inputCols=FEATURES, outputCol="_v")
    fit = cut(features(train.where(of(2, 3)), "_id", "_text", lexicon, ["_label", "_part", "_weight"]).repartitionByRange(8, "_id").sortWithinPartitions("_id"))
    trained = GBTClassifier(featuresCol="_v", labelCol="_label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).fit(pack.transform(fit.where(of(2))))
    raw = lambda df: trained.transform(pack.transform(df)).withColumn("_x", vector_to_array("probability")[1])
    calibrated = IsotonicRegression(featuresCol="_x", labelCol="_label", weightCol="_weight", predictionCol="_s").fit(raw(fit.where(of(3))).select("_x", "_weight", F.col("_label").cast("double").alias("_label")))
    out = calibrated.transform(raw(features(docs, id, text, lexicon, list(keep))).select(id, *keep, "_x"))
    out = out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_s")))).drop("_x", "_s")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document scored; ids with crc32 mod 5 of 0 are held out from learning."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    out = score(docs, labels, may_learn=remainder != 0)
    return out.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", "predicted")
