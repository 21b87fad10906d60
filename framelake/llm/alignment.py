"""Alignment of two tokenizers: which byte-level BPE tokens and which pieces of a sentencepiece model cover the same bytes.

A text is cut before blanks that stand between two other characters, where neither tokenizer ever joins
(`Pair` checks that for the pieces); each different word of a batch is encoded once. A token's end comes
from the tokenizer's own spans as a coarse cut: character offsets of the byte-level BPE, and spans of the
sentencepiece proto for words that are not plain ASCII (in ASCII a piece's span is its length). Where
spans do not add up, inside multibyte characters and for byte-fallback tokens, the decoded bytes refine
them. The installed sentencepiece calls its spans `proto` and refuses their former name, `immutable_proto`.

Token ids are written once, packed. Links are counted from them in each task before the shuffle, and the
counts come back in blocks of bounded size, all pairs of one piece in the same block.

Defined results: texts that are null or empty, and texts whose joined token bytes differ from a blank
and the text for either tokenizer, have no tokens: all numbers are 0, the digest is ''. Special tokens'
strings are plain text. Every row is kept, repeated and null ids too; equal texts get equal results; all
partners that tie for a piece's highest count are best. An empty table gives no rows. Only the id and
the text are read, whole.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, pieces

#: Folder of the tokenizers' files; only the driver reads it.
FOLDER = "/opt/tokenizers"
#: Pairs of ids with their counts in one broadcast, 16 bytes each.
BLOCK = 4_000_000
#: Characters that are encoded, and bytes of packed ids that are aligned, at once; the latter take some 100 times their size.
PIECE, PACK = 2 << 20, 1 << 20
#: Words that a worker remembers, some 400 bytes each.
WORDS = 600_000
#: A blank where both tokenizers start anew, and white space other than blanks and line ends.
BETWEEN, RARE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"[^\S \n]")
#: Ids are packed in two bytes.
PACKED = "<u2"


def words_of(text: str) -> list[str]:
    """The words of a blank and the text (not empty), each without the blank that it starts with."""
    if text[0] != " " and text[-1] != " " and "  " not in text and " \n" not in text and "\n " not in text and not RARE.search(text):
        return text.split(" ")
    first, *rest = BETWEEN.split(" " + text)
    return [first[1:], *rest]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokens:
    """Tokens of a run of words: `ids`, each token's `end` in bytes of its word, and word i's tokens from bounds[i] to bounds[i + 1]."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, end: np.ndarray):
        self.ids, self.end, self.bounds = ids, end, np.concatenate([[0], np.cumsum(counts)])


class Pair:
    """The two tokenizers, and the bytes of every id of each."""

    def __init__(self, bpe: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("a piece goes on after a blank, so words cannot be encoded apart")
        letters = byte_letters()
        named = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        if max(named[-1][1], len(names)) >= 1 << 16:
            raise ValueError("ids do not fit in two bytes")
        a = {k: bytes(letters[c] for c in x) if set(x) <= letters.keys() else x.encode() for x, k in named}
        self.a_bytes = [a.get(k, b"") for k in range(named[-1][1] + 1)]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def encode(self, words: list[str]) -> tuple[Tokens, Tokens, np.ndarray]:
        """Tokens of a blank and each word by both, and the words of which either one's bytes differ."""
        whole = [" " + w for w in words]
        raw = np.frombuffer("".join(whole).encode("utf-8", "surrogatepass"), np.uint8)
        at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where each character starts
        starts = np.concatenate([[0], np.cumsum([len(w) for w in whole])])
        begin = at[starts]
        plain = np.array([w.isascii() for w in words], bool)
        easy, hard = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        a_ids: list[list[int]] = [[]] * len(words)
        b_ids: list[list[int]] = [[]] * len(words)
        a_ends, b_ends = [], []
        for k, found in zip(easy, self.a.encode_batch_fast([whole[k] for k in easy], add_special_tokens=False), strict=True):
            a_ids[k] = found.ids
        for k, found in zip(hard, self.a.encode_batch([whole[k] for k in hard], add_special_tokens=False), strict=True):
            a_ids[k] = found.ids
            a_ends.append(at[starts[k] + np.array([x[1] for x in found.offsets], np.int64)] - begin[k])
        for k, ids in zip(easy, self.b.encode([words[k] for k in easy], num_threads=1), strict=True):
            b_ids[k] = ids
        for k, proto in zip(hard, self.b.encode([words[k] for k in hard], return_type="proto", num_threads=1), strict=True):
            spans = proto.pieces
            b_ids[k] = [p.id for p in spans]
            b_ends.append(np.array([p.end + 1 for p in spans], np.int64))
        made = []
        for found, size, ends in ((a_ids, self.a_size, a_ends), (b_ids, self.b_size, b_ends)):
            n = np.array([len(x) for x in found], np.int64)
            ids = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(n.sum()))
            upto = np.cumsum(size[ids])
            end = upto - np.repeat(np.concatenate([[0], upto])[np.cumsum(n) - n], n)
            spanned = np.repeat(~plain, n)
            if hard:
                end[spanned] = refined(np.concatenate(ends), size[ids][spanned], n[~plain])
            made.append(Tokens(ids, n, end))
        a, b = made
        return a, b, ~(same_bytes(a, self.a_bytes, raw, begin) & same_bytes(b, self.b_bytes, raw, begin))


def refined(coarse: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ends of tokens within their words: the coarse ones where they are apart by the token's decoded bytes, else those bytes counted on from the last good end."""
    first = np.cumsum(counts) - counts
    first = first[counts > 0]
    before = np.concatenate([[0], coarse[:-1]])[: len(coarse)]
    before[first] = 0
    good = coarse - before == size
    upto = np.cumsum(size)
    start = np.zeros(len(coarse), bool)
    start[first] = True
    # a token is anchored at the last good one of its word that only good ones precede since the word's start
    broken = ~good
    runs = np.cumsum(broken)
    since = runs - np.repeat(np.where(first > 0, runs[first - 1], 0), counts[counts > 0])
    base = np.repeat(np.where(first > 0, upto[first - 1], 0), counts[counts > 0])
    return np.where(since == 0, coarse, upto - base)


def same_bytes(tokens: Tokens, table: list[bytes], raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether the tokens of each word decode to its bytes, raw[begin[i]:begin[i + 1]]."""
    joined = b"".join(map(table.__getitem__, tokens.ids.tolist()))
    if len(joined) == len(raw) and joined == raw.tobytes():
        return np.ones(len(begin) - 1, bool)
    data, lo = raw.tobytes(), tokens.bounds
    return np.array([b"".join(table[k] for k in tokens.ids[lo[i] : lo[i + 1]].tolist()) == data[begin[i] : begin[i + 1]] for i in range(len(begin) - 1)], bool)


def gathered(bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all items of the groups `at`, in order, and each group's number of items."""
    n = bounds[at + 1] - bounds[at]
    upto = np.cumsum(n)
    return np.repeat(bounds[at] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0), n


class Encoder:
    """Encodes texts and keeps what it has learned about their words: tokens by both tokenizers, and the word's groups written out. Starts anew after WORDS words."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = [np.zeros(0, PACKED), np.zeros(0, PACKED)]
        self.bounds = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.written: list[bytes] = []
        self.odd = np.zeros(0, bool)

    def learn(self, words: list[str]) -> None:
        a, b, odd = self.pair.encode(words)
        packed = []
        for t in (a, b):
            raw = t.ids.astype(PACKED).tobytes()
            packed.append([raw[s:e] if fine else b"" for (s, e), fine in zip(itertools.pairwise((2 * t.bounds).tolist()), (~odd).tolist(), strict=True)])
        self.written += Aligned(*packed, self.pair.a_size, self.pair.b_size).written()
        for k, tokens in enumerate((a, b)):
            self.ids[k] = np.concatenate([self.ids[k], tokens.ids.astype(PACKED)])
            self.bounds[k] = np.concatenate([self.bounds[k], self.bounds[k][-1] + tokens.bounds[1:]])
        self.odd = np.concatenate([self.odd, odd])

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes], list[str]]:
        """The packed ids of each text by both tokenizers, and the digest of its groups; empty where a text has no tokens."""
        if len(self.index) > WORDS:
            self.forget()
        gc.disable()  # what follows makes many lists and no cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes], list[str]]:
        split = [words_of(t) if t else [] for t in texts]
        ends = np.cumsum([len(s) for s in split])
        known, index = len(self.index), self.index
        codes = [index.setdefault(w, len(index)) for w in itertools.chain.from_iterable(split)]
        if len(index) > known:
            self.learn(list(itertools.islice(index, known, None)))
        at = np.array(codes, np.int64)
        out = []
        for ids, bounds in zip(self.ids, self.bounds, strict=True):
            place, n = gathered(bounds, at)
            found, stops = ids[place], np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends])]
            out.append([found[s:e].tobytes() for s, e in itertools.pairwise(stops.tolist())])
        written = self.written
        digests = [hashlib.sha256(b";".join([written[c] for c in codes[s:e]])).hexdigest() if e > s else "" for s, e in itertools.pairwise([0, *ends.tolist()])]
        bad = np.concatenate([[0], np.cumsum(self.odd[at])])[np.concatenate([[0], ends])]
        for i in np.flatnonzero(np.diff(bad)).tolist():
            self.judge(texts[i], i, out, digests)
        return out[0], out[1], digests

    def judge(self, text: str, i: int, out: list[list[bytes]], digests: list[str]) -> None:
        """Settles a text with odd words by all of its bytes."""
        want = (" " + text).encode("utf-8", "surrogatepass")
        if all(b"".join(map(t.__getitem__, np.frombuffer(o[i], PACKED).tolist())) == want for t, o in zip((self.pair.a_bytes, self.pair.b_bytes), out, strict=True)):
            digests[i] = hashlib.sha256(Aligned([out[0][i]], [out[1][i]], self.pair.a_size, self.pair.b_size).written()[0]).hexdigest()
        else:
            out[0][i] = out[1][i] = b""
            digests[i] = ""


@functools.lru_cache(1)
def encoder(bpe: str, model: bytes) -> Encoder:
    """A worker's encoder; it outlives a task."""
    return Encoder(Pair(bpe, model))


def encode(docs: DataFrame, bpe: str, model: bytes, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, a, b: the packed token ids of every text by the two tokenizers (two bytes each, least first), and groups_sha256; written to the shared folder."""
    rows = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    files = docs.sparkSession.sparkContext.broadcast((bpe, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(*files.value)
        for batch in batches:
            for first, texts in pieces(batch, "_text", PIECE):
                a, b, digests = own.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(first, len(texts)), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(digests, pa.string())], names=["_id", "a", "b", "groups_sha256"])

    return cut(rows.mapInArrow(run, f"_id {kind}, a binary, b binary, groups_sha256 string")).withColumnRenamed("_id", id)


class Aligned:
    """The alignment of a run of texts. Both tokenizers' ends count bytes over all texts, of which each has as many by either."""

    def __init__(self, a: list[bytes], b: list[bytes], a_size: np.ndarray, b_size: np.ndarray):
        self.a, self.b = (np.frombuffer(b"".join(x), PACKED).astype(np.int64) for x in (a, b))
        self.a_end, self.b_end = np.cumsum(a_size[self.a]), np.cumsum(b_size[self.b])
        self.a_of, self.b_of = (np.concatenate([[0], np.cumsum([len(x) // 2 for x in v])]) for v in (a, b))
        total = int(self.a_end[-1]) if len(self.a_end) else 0
        marks = np.zeros(total + 1, np.uint8)
        marks[self.a_end] |= 1
        marks[self.b_end] |= 2
        ends = np.flatnonzero(marks)
        kind = marks[ends]
        #: Each link's tokens: no token ends between two ends, so one of each lies there.
        self.link_a = np.cumsum(kind & 1, dtype=np.int64) - (kind & 1)
        self.link_b = np.cumsum(kind >> 1, dtype=np.int64) - (kind >> 1)
        self.common = ends[kind == 3]
        stop = np.concatenate([[0], self.a_end])[self.a_of]
        self.links_of, self.groups_of = np.searchsorted(ends, stop, "right"), np.searchsorted(self.common, stop, "right")

    def keys(self) -> np.ndarray:
        """One number for each link's ids, the piece's first."""
        return self.b[self.link_b] << 32 | self.a[self.link_a]

    def written(self) -> list[bytes]:
        """Each text's groups written out."""
        n_a, n_b = len(self.a), len(self.b)
        if not n_a:
            return [b""] * (len(self.a_of) - 1)
        a_before = np.concatenate([[0], np.searchsorted(self.a_end, self.common, "right")])
        b_before = np.concatenate([[0], np.searchsorted(self.b_end, self.common, "right")])
        a_group, b_group = np.searchsorted(self.common, self.a_end), np.searchsorted(self.common, self.b_end)
        place_a, place_b = np.arange(n_a) + b_before[a_group], np.arange(n_b) + a_before[b_group + 1]
        ids, after = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        after[place_a[self.common[a_group] == self.a_end]] = ord("|")
        after[place_b[self.common[b_group] == self.b_end]] = ord(";")
        digits, shown = decimals()
        letters, used = np.empty((len(ids), 6), np.uint8), np.ones((len(ids), 6), bool)
        letters[:, :5], letters[:, 5] = digits[ids], after
        used[:, :5] = shown[ids]
        written = letters[used].tobytes()
        at = np.concatenate([[0], np.cumsum(used.sum(1))])[self.a_of + self.b_of]
        return [written[s : max(s, e - 1)] for s, e in itertools.pairwise(at.tolist())]


@functools.lru_cache(1)
def decimals() -> tuple[np.ndarray, np.ndarray]:
    """Five digits of each number below 2^16, and which of them are written."""
    numbers = np.arange(1 << 16)
    digits = numbers[:, None] // 10 ** np.arange(4, -1, -1) % 10
    return (digits + ord("0")).astype(np.uint8), numbers[:, None] >= np.array([10_000, 1_000, 100, 10, 0])


def packed_pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """The batch's packed ids in runs of about PACK bytes, with the first row of each."""
    a, b, first, held = [], [], 0, 0
    for i, (x, y) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True), 1):
        a.append(x.as_py())
        b.append(y.as_py())
        held += len(a[-1]) + len(b[-1])
        if held >= PACK or i == batch.num_rows:
            yield first, a, b
            a, b, first, held = [], [], i, 0


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, found = pd.factorize(np.concatenate(keys))
    return found, np.bincount(codes, np.concatenate(counts), len(found)).astype(np.int64)


def link_counts(tokens: DataFrame, a_size: np.ndarray, b_size: np.ndarray) -> DataFrame:
    """b, pair and n of each linked pair of ids over all rows, written; pair is b * 2^32 + a. Tasks add up before the shuffle."""
    sizes = tokens.sparkSession.sparkContext.broadcast((a_size, b_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for _, a, b in packed_pieces(batch):
                codes, found = pd.factorize(Aligned(a, b, *sizes.value).keys())
                keys.append(found)
                counts.append(np.bincount(codes, minlength=len(found)))
                if sum(map(len, keys)) > BLOCK // 2:
                    keys, counts = ([x] for x in summed(keys, counts))
        found, total = summed(keys, counts)
        for s in range(0, len(found), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[s : s + 100_000]), pa.array(total[s : s + 100_000])], names=["pair", "n"])

    rows = tokens.select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return cut(rows.withColumn("b", F.shiftright("pair", 32)))


def count_blocks(counts: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs in order, their counts, and whether each is its piece's highest, in blocks of at most `most` pairs unless one piece has more. The driver holds a block at a time, and one number a piece."""
    sizes = counts.groupBy("b").count().orderBy("b").toArrow()
    block, upto = [], 0
    for b, n in zip(sizes.column("b").to_pylist(), sizes.column("count").to_pylist(), strict=True):
        if upto and upto + n > most:
            block.append(b)
            upto = 0
        upto += n
    for low, high in itertools.pairwise([0, *block, 1 << 32]):
        part = counts.where((F.col("b") >= low) & (F.col("b") < high)).select("pair", "n").toArrow()
        pair, n = (part.column(c).to_numpy() for c in ("pair", "n"))
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        new = np.flatnonzero(np.diff(pair >> 32, prepend=-1))
        best = np.repeat(np.maximum.reduceat(n, new), np.diff(np.append(new, len(n)))) if len(n) else n
        yield pair, n, n == best


def scored(tokens: DataFrame, counts: DataFrame, a_size: np.ndarray, b_size: np.ndarray, id: str = "doc_id", most: int = BLOCK) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row. With several blocks of counts each is a pass over the packed ids, and the passes' sums are added up row by row."""
    context = tokens.sparkSession.sparkContext
    names, kept = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"], ["_id", "a", "b", "groups_sha256"]
    tokens = tokens.select(F.col(id).alias("_id"), "a", "b", "groups_sha256")

    def passed(rows: DataFrame, block: tuple[np.ndarray, np.ndarray, np.ndarray], last: bool) -> DataFrame:
        shared = context.broadcast((a_size, b_size, *block))
        more = ["best0", "sum0"] if "sum0" in rows.columns else []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizes, (pair, n, best) = shared.value[:2], shared.value[2:]
            for batch in batches:
                for first, a, b in packed_pieces(batch):
                    part = batch.slice(first, len(a))
                    held = Aligned(a, b, *sizes)
                    codes, keys = pd.factorize(held.keys())
                    at = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
                    there = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
                    sums = []
                    for value in (best, n):
                        own = np.where(there, value[at] if len(pair) else 0, 0).astype(np.int64)[codes]
                        sums.append(np.diff(np.concatenate([[0], np.cumsum(own)])[held.links_of]))
                    if more:
                        sums = [s + part.column(c).to_numpy() for s, c in zip(sums, more, strict=True)]
                    if last:
                        values = [np.diff(held.a_of), np.diff(held.b_of), np.diff(held.groups_of), np.diff(held.links_of), *sums]
                        yield pa.RecordBatch.from_arrays([part.column("_id"), *map(pa.array, values), part.column("groups_sha256")], names=["_id", *names, "groups_sha256"])
                    else:
                        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *map(pa.array, sums)], names=[*kept, "best0", "sum0"])

        kind = dict(rows.dtypes)["_id"]
        out = ", ".join([f"_id {kind}", *([f"{c} long" for c in names] + ["groups_sha256 string"] if last else ["a binary, b binary, groups_sha256 string, best0 long, sum0 long"])])
        return rows.mapInArrow(run, out)

    rows, blocks = tokens, count_blocks(counts, most)
    block = next(blocks)
    for following in blocks:
        rows, block = cut(passed(rows, block, False)), following
    return passed(rows, block, True).withColumnRenamed("_id", id)


def groups(tokens: DataFrame, a_size: np.ndarray, b_size: np.ndarray, id: str = "doc_id") -> DataFrame:
    """The alignment itself: id and groups, an array of (end, a, b): the group's end in bytes, and the ids of each tokenizer in it."""
    sizes = tokens.sparkSession.sparkContext.broadcast((a_size, b_size))
    kind = pa.list_(pa.struct([("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                one = Aligned([x], [y], *sizes.value)
                cuts = [np.split(ids, np.searchsorted(end, one.common[:-1], "right")) for ids, end in ((one.a, one.a_end), (one.b, one.b_end))]
                made.append([{"end": e, "a": p, "b": q} for e, p, q in zip(one.common.tolist(), *cuts, strict=True)] if len(one.common) else [])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(made, kind)], names=["_id", "groups"])

    rows = tokens.select(F.col(id).alias("_id"), "a", "b")
    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, groups array<struct<end: long, a: array<int>, b: array<int>>>").withColumnRenamed("_id", id)


def align(docs: DataFrame, bpe: str, model: bytes, id: str = "doc_id", text: str = "text", most: int = BLOCK) -> DataFrame:
    """Encodes every text, counts the links of all, and scores each row by them; see `scored`."""
    pair = Pair(bpe, model)
    tokens = encode(docs, bpe, model, id, text)
    return scored(tokens, link_counts(tokens, pair.a_size, pair.b_size), pair.a_size, pair.b_size, id, most)


def files(folder: str = FOLDER) -> tuple[str, bytes]:
    """The two tokenizers' files, as `align` takes them."""
    with open(f"{folder}/byte_bpe_50k.json", encoding="utf-8") as bpe, open(f"{folder}/piece_bpe_32k.model", "rb") as model:
        return bpe.read(), model.read()


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by both tokenizers, aligned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return align(docs, *files())
