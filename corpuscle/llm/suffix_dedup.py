"""Removal of repeated byte strings by sorted suffixes with common-prefix values, induced from sampled suffixes.

As in external suffix sorting by induction, only sampled suffixes are sorted by their bytes; the order of all others,
and the common-prefix values of neighbours, follow from those by prepending one byte at a time. The samples are chosen by
content: of the short grams in a window of ``length`` bytes the one with the least hash. Equal windows choose the same
gram at the same offset, so all suffixes that can share ``length`` bytes have a sample with the same gram to their right.
That makes the groups of suffixes with one sample gram independent, and Spark deals them out as shards.

Spark's external sort (memory first, then sorted runs on disk, merged by a queue) stands for the disk-backed priority
queues: it brings the tuples of a shard in the order of their sampled suffixes, however large the task's share. The
tuples then pass in blocks of bounded size. A shard of more tuples than a block is dealt out again by half of the bytes
that its tuples have yet to share, on either side of what they share for certain; so it goes on, in halves, until the
shards fit or share a whole window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import join_uneven, materialize, text_bytes, text_id, without_uneven

#: Bytes of the sampled grams. Long enough that short set phrases don't make groups, short enough that samples are rare.
GRAM = 100
#: Windows sampled at a time in a long text; positions in such a block fit in 20 bits.
BLOCK = 1 << 19
#: Suffix tuples induced at a time (more only to end a shard), and the tuples of a shard above which it is dealt out again.
TUPLES, GROUP = 1 << 14, 1 << 15

_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, p)], dtype=np.uint64) for p in (_P, _PI)]
    return _powers


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram of consecutive bytes."""
    n = len(data) - gram + 1
    up, down = _power_tables(len(data))
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)
    h = total[gram - 1 :].copy()
    h[1:] -= total[: n - 1]
    h *= down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def sampled(data: bytes, length: int, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows of ``length`` bytes with one sample: (first window, last window, sample's place, gram's hash)."""
    width = length - gram + 1
    for at in range(0, len(data) - length + 1, BLOCK):
        part = np.frombuffer(data, np.uint8, min(BLOCK + length - 1, len(data) - at), at)
        h = gram_hashes(part, gram)
        places = np.arange(len(h), dtype=np.uint64)
        keyed = (h & ~np.uint64(0xFFFFF)) | places  # ties go to the left
        rows = -(-len(keyed) // width)
        table = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        table[: len(keyed)] = keyed
        table = table.reshape(rows, width)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(part) - length + 1
        place = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], windows] - 1
        yield first + at, last + at, place[first] + at, h[place[first]].view(np.int64)


RUNS = "t1 long, t2 long, gram long, context long, packed long"


def _runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row for each run of windows; packed holds its first window (44 bits), the sample's offset and the run's length - 1."""
    for batch in batches:
        t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        size = 0
        for i, x in enumerate(batch.column(2)):
            data = x.as_py()
            for first, last, place, gram in sampled(data, length):
                context = np.fromiter((xxhash.xxh3_64_intdigest(data[s : e + length], o) for s, e, o in zip(first.tolist(), last.tolist(), (place - first).tolist(), strict=True)), np.uint64, len(first))
                packed = (first << 20) | ((place - first) << 10) | (last - first)
                for held, new in zip(out, (np.full(len(first), t1[i]), np.full(len(first), t2[i]), gram, context.view(np.int64), packed), strict=True):
                    held.append(new)
                size += len(first)
            if size > 1 << 16:
                yield _batch(out)
                out, size = [[] for _ in range(5)], 0
        if size:
            yield _batch(out)


def _batch(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["t1", "t2", "gram", "context", "packed"])


PIECES = "gram long, context long, run int, head binary, tail binary"


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted run from its first window's start to its last window's end, cut before the sample."""
    names = ["gram", "context", "run", "head", "tail"]
    for batch in batches:
        out: list[tuple] = []
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            raw = text.as_py()
            for w in wanted.as_py():
                first, place, run = w["packed"] >> 20, (w["packed"] >> 10) & 1023, w["packed"] & 1023
                out.append((w["gram"], w["context"], run, raw[first : first + place], raw[first + place : first + run + length]))
            if len(out) > 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _PIECES, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _PIECES, strict=True)], names=names)


_PIECES = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]


def _least_between(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(lcp[low + 1 : high + 1]) for each pair, low < high."""
    out = np.empty(len(low), lcp.dtype)
    if not len(low):
        return out
    span = high - low
    level = np.frexp(span.astype(np.float64))[1] - 1
    table = lcp
    for k in range(int(level.max()) + 1):
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[low[own] + 1], table[high[own] + 1 - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def induced(group: np.ndarray, offset: np.ndarray, run: np.ndarray, data: list[bytes], length: int) -> list[np.ndarray]:
    """For each context the windows (as distances from its first) whose bytes another context of its group has too.

    Contexts come in the order of their groups and of the suffixes at their samples, ``offset`` bytes after their start.
    The suffix one byte to the left then has its place by that byte and the place so far, and its common prefix with its
    new neighbour is one more than the least between them before.
    """
    n = len(data)
    found: list[list[int]] = [[] for _ in range(n)]
    order, lcp = np.arange(n), np.zeros(n, np.int64)
    for at in range(0, n, 4096):  # neighbours' common prefixes, a block of padded rows at a time
        own = order[max(0, at - 1) : at + 4096]
        width = 2 * length
        rows = np.zeros((len(own), width), np.uint8)
        sizes = np.empty(len(own), np.int64)
        for k, i in enumerate(own):
            piece = data[i][offset[i] : offset[i] + width]
            rows[k, : len(piece)] = np.frombuffer(piece, np.uint8)
            sizes[k] = len(piece)
        differ = rows[1:] != rows[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        same = np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))
        same[group[own[1:]] != group[own[:-1]]] = 0
        lcp[max(1, at) : max(1, at) + len(same)] = same
    starts = np.cumsum(np.r_[0, [len(x) for x in data[:-1]]])
    joined = np.frombuffer(b"".join(data), np.uint8)
    for j in range(int(offset.max()) + 1):
        if j:
            byte = joined[starts[order] + offset[order] - j].astype(np.int64)
            by = np.argsort(group[order] * 256 + byte, kind="stable")
            key = (group[order] * 256 + byte)[by]
            near = np.flatnonzero(key[1:] == key[:-1])
            fresh = np.zeros(len(by), np.int64)
            fresh[near + 1] = 1 + _least_between(lcp, by[near], by[near + 1])
            order, lcp = order[by], fresh
        best = np.maximum(lcp, np.r_[lcp[1:], 0])
        own = (best >= length) & (offset[order] - j <= run[order])
        for i in order[own].tolist():
            found[i].append(int(offset[i]) - j)
        # what can still reach the length stays; between the neighbours left, the least common prefix passes on
        stay = np.flatnonzero((offset[order] > j) & (best + offset[order] - j >= length))
        if len(stay) < 2:
            break
        passed = np.zeros(len(stay), np.int64)
        passed[1:] = _least_between(lcp, stay[:-1], stay[1:])
        order, lcp = order[stay], passed
    return [np.array(x[::-1], np.int64) for x in found]


def _spans_of(windows: np.ndarray) -> list[int]:
    """Windows in order as first, last, first, last ... of each unbroken run."""
    cut = np.flatnonzero(np.diff(windows) != 1)
    return np.stack([windows[np.r_[0, cut + 1]], windows[np.r_[cut, len(windows) - 1]]], axis=1).ravel().tolist()


def _induce(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """frames: tuples ordered by shard and sampled suffix; the repeated windows of each that has any."""
    rest: list[pd.DataFrame] = []
    held = 0

    def solved(frame: pd.DataFrame) -> pd.DataFrame:
        group = np.unique(frame["shard"].to_numpy(), return_inverse=True)[1]
        heads = frame["head"].tolist()
        offset = np.array([len(h) for h in heads], np.int64)
        data = [h + t for h, t in zip(heads, frame["tail"], strict=True)]
        windows = induced(group, offset, frame["run"].to_numpy(np.int64), data, length)
        out = frame.loc[np.array([len(w) > 0 for w in windows], bool), ["gram", "context"]].copy()
        out["spans"] = pd.Series([_spans_of(w) for w in windows if len(w)], index=out.index, dtype=object)
        return out

    for frame in frames:
        rest.append(frame)
        held += len(frame)
        if held >= TUPLES:
            frame = pd.concat(rest, ignore_index=True)
            shard = frame["shard"].to_numpy()
            cut = int(np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])[-1])  # the last shard may go on
            if cut and len(out := solved(frame.iloc[:cut])):
                yield out
            rest, held = [frame.iloc[cut:]], len(frame) - cut
    if held and len(out := solved(pd.concat(rest, ignore_index=True))):
        yield out


def _repeated_windows(pieces: DataFrame, length: int) -> DataFrame:
    """``(gram, context, spans)`` for the contexts that share windows with another context of their gram.

    Two contexts that share a window hold it at one offset from the sample. Of the bytes of the window that a shard's
    tuples don't share for certain (``left`` bytes before the sample and ``right`` from it), half at least are on one
    side of those; so a tuple of a shard that is too large goes on to a shard of that many more bytes to its left, and
    one to its right, and each pair that shares a window meets again in one of the two.
    """
    found, now = [], pieces.select("*", F.col("gram").alias("shard"), F.lit(0).alias("left"), F.lit(GRAM).alias("right"))
    for level in range(length.bit_length() + 1):
        now = materialize(now, f"pieces-{level}")
        large = materialize(now.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > GROUP), f"large-shards-{level}")
        some, rest = bool(large.head(1)), F.lit(length) - F.col("left") - F.col("right")
        small = without_uneven(now, large, ["shard"], now.count()) if some else now
        small = small.repartition("shard").sortWithinPartitions("shard", "tail")
        found.append(small.mapInPandas(lambda f: _induce(f, length), "gram long, context long, spans array<int>"))
        if not some:
            break
        own = join_uneven(now, large, ["shard"], now.count())
        # what shares a whole window has it, however many they are
        window = F.octet_length("head") - F.col("left")
        found.append(own.where((rest <= 0) & window.between(0, F.col("run"))).select("gram", "context", F.array(window, window).alias("spans")))
        half = F.ceil(rest / 2).cast("int")
        before = F.substring(F.col("head"), F.octet_length("head") - F.col("left") - half + 1, half)
        after = F.substring(F.col("tail"), F.col("right") + 1, half)
        onward = [F.struct(F.xxhash64(F.lit(side), "shard", part).alias("shard"), (F.col("left") + (half if not side else 0)).alias("left"), (F.col("right") + (half if side else 0)).alias("right"), F.octet_length(part).alias("size")) for side, part in enumerate((before, after))]
        more = own.where(rest > 0).select("gram", "context", "run", "head", "tail", half.alias("half"), F.explode(F.array(*onward)).alias("to"))
        whole = F.when(F.col("to.left") > F.octet_length("head"), False).otherwise(F.col("to.size") == F.col("half"))
        now = more.where(whole).select("gram", "context", "run", "head", "tail", "to.shard", "to.left", "to.right")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.groupBy("gram", "context").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def repeated_spans(docs: DataFrame, length: int = 400, text_col: str = "text") -> DataFrame:
    """``(t1, t2, spans)``: for each text with repeated strings the byte ranges (start, end) that they cover, unmerged.

    The text is named by ``text_id``. A range is there for every run of windows of ``length`` bytes that also start
    elsewhere in the texts of ``docs``, copies of one text included.
    """
    if not GRAM < length <= GRAM + 1000:
        raise ValueError(f"length must be over {GRAM} and at most {GRAM + 1000}: a run and its sample's offset are packed in 10 bits")
    data = text_bytes(text_col)
    texts = docs.select(*text_id(data), data.alias("data")).where(F.length("data") >= length)
    runs = materialize(texts.mapInArrow(lambda b: _runs(b, length), RUNS), "runs")
    grams = runs.groupBy("gram").agg(F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("mixed")).where("n > 1")
    # only grams that occur again matter: few rows go on
    own = materialize(join_uneven(runs, materialize(grams, "grams"), ["gram"], runs.count()).drop("n"), "repeated-grams")
    contexts = own.groupBy("gram", "context", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "packed")).alias("at"))
    contexts = materialize(contexts.select("gram", "context", "mixed", "n", "at.*"), "contexts")
    whole = contexts.where("n > 1").select("gram", "context", "n", F.lit(None).cast("array<int>").alias("spans"))

    wanted = contexts.where("mixed").groupBy("t1", "t2").agg(F.collect_list(F.struct("gram", "context", "packed")).alias("wanted"))
    # a text once, however many copies it has: a gram's tuples are then as many as its contexts
    pieces = texts.dropDuplicates(["t1", "t2"]).join(wanted, ["t1", "t2"]).select("data", "wanted").mapInArrow(lambda b: _contexts(b, length), PIECES)
    partial = _repeated_windows(pieces, length).join(contexts.where("n = 1").select("gram", "context", "n"), ["gram", "context"])
    spans = materialize(whole.unionByName(partial), "spans")
    first, run = F.shiftright("packed", 20), F.col("packed").bitwiseAND(1023)
    hit = join_uneven(own, spans, ["gram", "context"], own.count()).select("t1", "t2", first.alias("first"), F.coalesce("spans", F.array(F.lit(0), run.cast("int"))).alias("spans"))
    each = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct((F.col("first") + F.get("spans", i)).alias("start"), (F.col("first") + F.get("spans", i + 1) + length).alias("end")))
    return hit.select("t1", "t2", F.inline(each)).groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_bytes, spans, kept)``, a row for each row of ``docs``: removed byte ranges and the bytes left.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another,
    judged on the texts as they come. Null and empty texts have no bytes; texts shorter than ``length`` keep all;
    repeated rows are copies of each other; null ids pass as they are; other columns play no part.
    """
    data = text_bytes(text_col)
    spans = repeated_spans(docs, length, text_col)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), data.alias("data"), *text_id(data)).join(spans, ["t1", "t2"], "left").select("id", "data", "spans")
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, kept = [], [], []
            for x, s in zip(batch.column(1), batch.column(2), strict=True):
                raw = x.as_py()
                ranges = merged([(r["start"], r["end"]) for r in s.as_py() or ()])
                at, parts = 0, []
                for a, b in ranges:
                    parts.append(raw[at:a])
                    at = b
                size.append(len(raw))
                gone.append([[*r] for r in ranges])
                kept.append(b"".join([*parts, raw[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)
