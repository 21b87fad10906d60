"""Language identification with spans: script ranges narrow the candidates, Viterbi labels the words.

A word's score in a language is the log probability of its letter trigrams (with word ends), learned
by counting. The script of a word's first letter leaves only languages seen in that script. Viterbi
over the words, with a penalty for each switch, gives the spans; the language with most letters is
the document's, and its share of the letters the score. The score tells how much of a text is in
its main language; it is no measure of how well the text fits that language.

Defined results: a null text, or one without a letter, is `und` with score 0; combining marks
belong to words but are no letters; letters in a script that no learned language uses count for
none, and a text of such letters alone gets the language most often learned, with score 0; ties go
to the language first in code-point order; with nothing to learn from, every text is `und`. Texts
are read whole. Equal texts get equal results. Only the id, the text and the label are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mixed, pieces, small

#: First and last code points of scripts (fixed values of the Unicode blocks, main ranges only).
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x139F), ("kana", 0x3040, 0x30FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x3FFFF),
)
NAMES = ["other", *dict.fromkeys(s[0] for s in SCRIPTS)]
#: Trigrams are hashed into so many bins; after them come one bin per script.
BINS = 1 << 16
#: Log-probability cost of a switch of language between two words.
SWITCH = 15.0
#: A language uses a script if this share of its words does.
SEEN = 0.001


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it belongs to words (letters and marks), whether it is a letter, and its script."""
    kinds = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint8)
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = NAMES.index(name)
    return (kinds == ord("L")) | (kinds == ord("M")), kinds == ord("L"), script


def _words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Trigram bin at each letter or mark, their bounds by word, script by word, words' bounds by text, words' places in the texts, letters by word."""
    parts, letters, script = _tables()
    low = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    inside = parts[points]
    at = np.flatnonzero(inside)
    padded = np.zeros(len(points) + 2, np.uint64)
    padded[1:-1] = np.where(inside, points, 0)
    grams = mixed(padded[at] * np.uint64(0x9E3779B1) + padded[at + 1] * np.uint64(0x85EBCA77C2B2AE3D) + padded[at + 2] * np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(BINS - 1)
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = np.searchsorted(at, start)
    text_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    letter = np.concatenate([[0], np.cumsum(letters[points])])
    return grams.astype(np.int64), cuts, script[points[start]] if len(start) else np.zeros(0, np.uint8), np.searchsorted(start, text_at), start, end, text_at, letter[end] - letter[start]


class Model:
    """Languages in code-point order, log probabilities by bin, and the languages that each script leaves."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table = np.array([counts[k] for k in self.languages], np.float64) if counts else np.zeros((0, BINS + len(NAMES)))
        grams, scripts = table[:, :BINS], table[:, BINS:]
        self.logp = np.ascontiguousarray(np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BINS)).T.astype(np.float32))
        self.may = (scripts >= SEEN * np.maximum(scripts.sum(1, keepdims=True), 1)).T & (scripts.T > 0)
        self.usual = int(np.argmax(scripts.sum(1))) if counts else -1


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", may_learn: Column | None = None, sample: int = 3_000) -> Model:
    """Counts trigrams per language over about `sample` labelled documents of each language, drawn by a hash of id and text.

    A language with fewer documents is learned from all of them, so every label is learned.
    Tasks sum what they read before the shuffle; at most (bins x languages) sums reach the driver.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows if may_learn is None else rows.where(may_learn)
    rows = rows.select(F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"), F.pmod(F.xxhash64(F.lit("language"), id, F.length(text)), F.lit(1_000_000)).alias("_u"))
    shares = cut(rows.groupBy("_lang").count().select(F.col("_lang").alias("_l"), (1_000_000 * F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count"))).alias("_most")))
    rows = rows.join(small(shares), F.col("_lang") == F.col("_l")).where("_u < _most").select("_text", "_lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("_lang").to_pylist()
            for first, texts in pieces(batch, "_text"):
                own = langs[first : first + len(texts)]
                for k in set(own):
                    grams, _, scripts, *_ = _words([t for t, of in zip(texts, own, strict=True) if of == k])
                    total = sums.setdefault(k, np.zeros(BINS + len(NAMES), np.int64))
                    total[:BINS] += np.bincount(grams, minlength=BINS)
                    total[BINS:] += np.bincount(scripts, minlength=len(NAMES))
        for k, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bin", "n"])

    found = rows.mapInArrow(count, "lang string, bin int, n long")
    counts: dict[str, np.ndarray] = {}
    table = found.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    for k, b, c in zip(*(table.column(x).to_pylist() for x in ("lang", "bin", "n")), strict=True):
        counts.setdefault(k, np.zeros(BINS + len(NAMES)))[b] = c
    return Model(counts)


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path of each text. Texts in which no run of words favours another language by half the penalty keep one label; the others go step by step, all at once."""
    n, k = scores.shape
    texts = len(bounds) - 1
    path = np.zeros(n, np.int16)
    if not n:
        return path
    doc = np.repeat(np.arange(texts), np.diff(bounds))
    sums = np.concatenate([np.zeros((1, k)), np.cumsum(scores, 0, dtype=np.float64)])
    total = sums[bounds[1:]] - sums[bounds[:-1]]
    best = total.argmax(1)
    path[:] = best[doc]
    calm = np.ones(texts, bool)
    apart = 10 * (abs(sums[-1]).max() + 1)  # so that the running minimum starts anew in each text
    for j in range(k):
        lead = np.concatenate([[0.0], np.cumsum(scores[:, j].astype(np.float64) - scores[np.arange(n), path])])
        low = np.minimum.accumulate(lead[:-1] - apart * doc) + apart * doc
        most = np.full(texts, -np.inf)
        np.maximum.at(most, doc, lead[1:] - low)
        calm &= most <= switch / 2 - 1e-6 * apart
    todo = np.flatnonzero(~calm)
    if not len(todo):
        return path
    todo = todo[np.argsort(-np.diff(bounds)[todo], kind="stable")]
    starts, lengths = bounds[todo], np.diff(bounds)[todo]
    back = np.zeros((n, k), np.int16)
    value = scores[starts].astype(np.float64)
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than t
    each = np.arange(k, dtype=np.int16)
    for t in range(1, steps):
        v, at = value[: active[t]], starts[: active[t]] + t
        top = v.argmax(1)
        high = v[np.arange(len(v)), top] - switch
        move = v < high[:, None]
        back[at] = np.where(move, top[:, None], each)
        value[: active[t]] = np.where(move, high[:, None], v) + scores[at]
    state = value.argmax(1)
    for t in range(steps - 1, -1, -1):
        at = starts[: active[t]] + t
        path[at] = state[: active[t]]
        if t:
            state[: active[t]] = back[at, state[: active[t]]]
    return path


def label(texts: list[str], model: Model) -> list[tuple[str, float, list[dict]]]:
    """(language, score, spans) of each text; a span is a run of words in one language."""
    grams, cuts, scripts, bounds, start, end, text_at, size = _words(texts)
    if not len(cuts) or not model.languages:
        return [("und", 0.0, [])] * len(texts)
    scores = np.add.reduceat(model.logp[grams], cuts, axis=0)
    may = model.may[scripts]
    known = may.any(1) & (size > 0)
    scores = np.where(known[:, None], np.where(may, scores, -1e4), 0).astype(np.float32)
    scores -= scores.max(1, keepdims=True)
    path = viterbi(scores, bounds)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    share = np.zeros((len(texts), len(model.languages)))
    np.add.at(share, (doc[known], path[known]), size[known])
    letters = np.bincount(doc, size.astype(np.float64), len(texts))
    new = np.flatnonzero(np.concatenate([[True], (np.diff(path) != 0) | (np.diff(doc) != 0)]))
    last = np.concatenate([new[1:], [len(path)]]) - 1
    first_of = np.searchsorted(doc[new], np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        if not letters[i]:
            out.append(("und", 0.0, []))
            continue
        k = int(share[i].argmax()) if share[i].any() else model.usual
        spans = [{"start": int(start[a] - text_at[i]), "end": int(end[b] - text_at[i]), "lang": model.languages[path[a]]} for a, b in zip(new[first_of[i] : first_of[i + 1]], last[first_of[i] : first_of[i + 1]], strict=True)]
        out.append((model.languages[k], float(share[i, k] / letters[i]), spans))
    return out


def identify(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, keep..., lang_pred, score and spans (start, end in code points of the lower-cased text, lang) of every row; no shuffle."""
    rows = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"), *keep)
    kept = ["_id", *keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch, "_text", 1 << 20):  # more texts at once: fewer steps of the search
                langs, scores, spans = zip(*label(texts, shared.value), strict=True)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(texts)) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)], names=[*kept, "lang_pred", "score", "spans"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"])
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; ids with crc32 mod 4 of 2 are held out from learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    out = identify(docs, learn(docs, may_learn=remainder != 2))
    return out.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
