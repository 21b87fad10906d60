"""GIF media columns: an encoder for byte payloads, and a decoder with LZW, palettes, disposal and transparency.

The decoder reads any GIF: global and local palettes, interlacing, frames smaller than the canvas,
transparent indices, disposal to background and to previous, and delays. It stores each shown
frame with its delay and colour-histogram columns; what a frame itself stores (its own rectangle
of indices) is kept too, so payloads come back without loss.

Defined results: a null or empty text is a payload of 64 zero bytes; equal payloads give equal
bytes and columns; a very long text becomes more frames of at most 64 KiB each; a decoded value
that is null or no GIF, whose code stream ends before its frame is full, whose canvas or frame has
more than `PIXELS` pixels, or whose frames have more than `SAMPLES` together, gives no frames and an
error text (so does a text of more bytes than that); an empty table gives no rows. Only
the id and the text (or media) column are read. A text is held whole, with its GIF, in one task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples across; payloads are multiples of it. Rows of a frame at most. Hundredths of a second that a frame shows.
WIDTH, ROWS, DELAY = 64, 1024, 4
#: Pixels of a canvas or frame that the decoder takes (4 bytes each); a header can claim 65535 x 65535.
PIXELS = 1 << 26
#: Samples of all frames of a file together that the decoder takes; a small file can claim any number.
SAMPLES = 1 << 28
#: Colour histogram: the two high bits of red, green and blue.
BINS = 64


def _packed(codes: list[int], widths: list[tuple[int, int]]) -> bytes:
    """Codes as bits, low bits first; widths: (number of codes, bits of each)."""
    bits, at = [], 0
    for n, width in widths:
        part = np.array(codes[at : at + n], np.uint16)
        bits.append(((part[:, None] >> np.arange(width, dtype=np.uint16)) & 1).astype(np.uint8).ravel())
        at += n
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def lzw_encode(data: bytes) -> bytes:
    """GIF's LZW for 8-bit samples: a clear code first and whenever the table is full, an end code last."""
    codes, widths = [256], []
    table: dict[int, int] = {}
    get, put, free, width, since = table.get, codes.append, 258, 9, 0
    prefix = data[0]
    for sample in memoryview(data)[1:]:
        key = prefix << 8 | sample
        code = get(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        prefix = sample
        if free == 4096:
            put(256)
            widths.append((len(codes) - since, 12))
            table.clear()
            since, free, width = len(codes), 258, 9
            continue
        table[key] = free
        if free == 1 << width:
            widths.append((len(codes) - since, width))
            since, width = len(codes), width + 1
        free += 1
    put(prefix)
    if free == 1 << width and width < 12:  # the decoder widens after the entry that this code completes
        widths.append((len(codes) - since, width))
        since, width = len(codes), width + 1
    put(257)
    widths.append((len(codes) - since, width))
    return _packed(codes, widths)


def lzw_decode(data: bytes, least: int, size: int) -> bytes:
    """The samples of a code stream with `least` bits a sample; ends at the end code, at `size` samples or where the stream does."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    clear, end, roots = 1 << least, (1 << least) + 1, [bytes([i]) for i in range(1 << least)] + [b"", b""]
    table, out, at, width, before = list(roots), [], 0, least + 1, b""
    add, put, held, counted = table.append, out.append, 0, 0
    while held < size:
        # as many codes of this width as fill the table; the first after a clear code makes no entry
        n = min((len(bits) - at) // width, max(1, (1 << width) - len(table) + (not before)) if width < 12 else 2048)
        if n <= 0:
            break
        codes = (bits[at : at + n * width].reshape(n, width).astype(np.uint16) << np.arange(width, dtype=np.uint16)).sum(1, dtype=np.uint16)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        run = codes[:stop].tolist()
        if not before and run:  # the first code after a clear code makes no entry
            before = table[run.pop(0)]
            put(before)
        for code in run:
            try:
                entry = table[code]
            except IndexError:
                if code != len(table):
                    raise ValueError("the code stream names an entry that is not there") from None
                entry = before + before[:1]
            if len(table) < 4096:
                add(before + entry[:1])
            before = entry
            put(entry)
        held += sum(map(len, out[counted:]))
        counted = len(out)
        used = min(n, stop + 1)
        code = int(codes[stop]) if stop < n else -1
        at += used * width
        if code == end:
            break
        if code == clear:
            table, before, width = list(roots), b"", least + 1
            add = table.append
        elif len(table) == 1 << width and width < 12:
            width += 1
    return b"".join(out)[:size]


def encode(payload: bytes) -> bytes:
    """A looping GIF of grey frames, 64 samples wide; frame i holds the payload's i-th 64 KiB."""
    rows = len(payload) // WIDTH
    high = min(rows, ROWS)
    palette = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, high, 0xF7, 0, 0), palette, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for first in range(0, rows, ROWS):
        part = payload[first * WIDTH : (first + ROWS) * WIDTH]
        stream = lzw_encode(part)
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08"]
        out += [bytes([len(b)]) + b for b in (stream[i : i + 255] for i in range(0, len(stream), 255))]
        out.append(b"\x00")
    return b"".join([*out, b"\x3b"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _interlaced(rows: np.ndarray) -> np.ndarray:
    order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, len(rows), step)]
    out = np.empty_like(rows)
    out[order] = rows
    return out


def frames_of(data: bytes) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(delay in ms, the frame's own samples, the canvas shown as height x width of packed 0xAARRGGBB) of each frame."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, ground, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    shared = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    if width * height > PIXELS:
        raise ValueError("the canvas is too large")
    canvas = np.zeros((height, width), np.uint32)
    delay, disposal, clear, held = 0, 0, None, 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            block, at = _blocks(data, at + 2)
            if label == 0xF9 and len(block) >= 4:
                packed, delay, index = struct.unpack("<BHB", block[:4])
                disposal, clear = packed >> 2 & 7, index if packed & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if packed & 0x80:
            n = 2 << (packed & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if w * h > PIXELS:
            raise ValueError("a frame is too large")
        held += w * h
        if held > SAMPLES:
            raise ValueError("the frames are too large together")
        least = data[at]
        if not 1 <= least <= 8:
            raise ValueError("no code size of samples")
        stream, at = _blocks(data, at + 1)
        samples = lzw_decode(stream, least, w * h)
        if len(samples) < w * h:
            raise ValueError("the code stream ends before the frame is full")
        index = np.frombuffer(samples, np.uint8).reshape(h, w)
        index = _interlaced(index) if packed & 0x40 else index
        if palette is None:
            raise ValueError("no palette")
        before = canvas.copy() if disposal == 3 else None
        box = canvas[top : top + h, left : left + w]
        inside = index[: box.shape[0], : box.shape[1]]
        wide = palette.astype(np.uint32)
        colours = np.full(256, 0xFF000000, np.uint32)
        colours[: len(wide)] |= wide[:, 0] << 16 | wide[:, 1] << 8 | wide[:, 2]
        if clear is None:
            box[:] = colours[inside]
        else:
            np.copyto(box, colours[inside], where=inside != clear)
        yield 10 * delay, samples, canvas
        if disposal == 2:
            box[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, clear = 0, 0, None


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of the shown pixels by the two high bits of each colour; transparent pixels do not count."""
    shown = canvas.ravel()
    bins = shown >> 18 & 0x30 | shown >> 12 & 0x0C | shown >> 6 & 0x03 | shown >> 25 & 0x40
    return np.bincount(bins, minlength=2 * BINS)[BINS:]


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


#: Bytes of media that make a batch of rows between Python and the JVM.
BATCH = 4 << 20


def to_gif(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One GIF per row: id, n_bytes, payload_bytes, media (binary)."""
    rows = docs.select(id, F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, made = 0, 0, []
            for i, text in enumerate(batch.column("_text"), 1):
                n, payload = padded(text.as_py())
                made.append((n, len(payload), encode(payload)))
                held += len(payload)
                if held >= BATCH or i == batch.num_rows:
                    kinds = (pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(id).slice(first, i - first), *(pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True))], names=[id, "n_bytes", "payload_bytes", "media"])
                    first, held, made = i, 0, []

    return rows.mapInArrow(run, f"`{id}` {dict(rows.dtypes)[id]}, n_bytes long, payload_bytes long, media binary")


FRAME = "struct<delay_ms: int, width: int, height: int, n_samples: long, histogram: array<long>>"


def decode(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds to a table of GIFs: frames (delay, canvas size, number of own samples, colour histogram of what is shown), samples (all frames' own samples in order), n_frames, duration_ms and error."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in media.dtypes), f"frames array<{FRAME}>", "samples binary", "error string"])
    kind = pa.list_(pa.struct([("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("n_samples", pa.int64()), ("histogram", pa.list_(pa.int64()))]))

    def read(value: bytes | None) -> tuple[list[dict], bytes, str | None]:
        found, parts = [], []
        try:
            if value is None:
                raise ValueError("null")
            for delay, own, canvas in frames_of(value):
                found.append({"delay_ms": delay, "width": canvas.shape[1], "height": canvas.shape[0], "n_samples": len(own), "histogram": histogram(canvas)})
                parts.append(own)
        except (ValueError, IndexError, struct.error) as e:
            return [], b"", str(e) or "truncated"
        return found, b"".join(parts), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, made = 0, 0, []
            for i, value in enumerate(batch.column(column), 1):
                made.append(read(value.as_py()))
                held += len(made[-1][1])
                if held >= BATCH or i == batch.num_rows:
                    kinds = (kind, pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, i - first) for c in batch.columns), *(pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True))], names=[*batch.schema.names, "frames", "samples", "error"])
                    first, held, made = i, 0, []

    out = media.mapInArrow(run, schema)
    return out.withColumn("n_frames", F.size("frames")).withColumn("duration_ms", F.aggregate("frames", F.lit(0).cast("long"), lambda a, f: a + f["delay_ms"]))


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a GIF and read back; the payload is the frames' samples in order."""
    read = decode(to_gif(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    level = lambda g: F.aggregate("frames", F.lit(0).cast("long"), lambda a, f: a + F.get(f["histogram"], F.lit(21 * g))).cast("string")
    grey = [level(g) for g in range(4)]
    feature = F.concat_ws(";", F.concat(F.lit("frames="), F.col("n_frames").cast("string")), F.concat(F.lit("ms="), F.col("duration_ms").cast("string")), F.concat(F.lit("grey="), F.concat_ws(",", *grey)))
    return read.select("doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.substring("samples", -WIDTH, WIDTH)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
