"""N-gram language model in a log-frequency Bloom filter, and exact unigram scores beside it.

A count c of an n-gram is held as its level 1 + floor(log2 c): the filter holds the pairs (n-gram, 1) to (n-gram, level), so
the level is read by asking for 1, 2, ... until the filter says no; it errs upward only, and seldom. An n-gram whose prefix
isn't held is not asked for, and no count counts as more than that of its prefix.

The filter is cut into cells by the n-gram's hash, a few MiB of text for each, and a cell is as large as what it holds needs,
so the model grows with the corpus. Cells are built where a shuffle brings their n-grams together. A filter (with the word
counts) of up to ``BROADCAST_BYTES`` is broadcast; a larger one stays a table, and the n-grams of the documents meet its cells
by shuffle. Both ways give the same scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize, text_bytes

#: Longest n-grams, weight of the shorter history (in counts), and what is added to the count of each word.
ORDER, PRIOR, ADDED = 2, 4.0, 0.1
#: Bits of the filter for each pair that it holds, and of these the bits that a pair sets, all in one 64-bit word.
BITS, SET = 11, 5
#: Text for each cell of the filter.
CELL_BYTES = 1 << 23
#: Filter and word counts that are broadcast at most.
BROADCAST_BYTES = 1 << 28
#: Text whose n-grams are taken together, and rows in a block of documents when the filter stays a table.
BLOCK_BYTES, BLOCK_ROWS = 1 << 21, 1 << 8

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
#: The symbol before the first word and the one after the last; no word is like them.
BEGIN, END = b"\n", b""


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


@dataclass
class Grams:
    """The n-grams of some documents: for each order their distinct hashes, and at each place the number of the one that ends there.

    Places are those of all symbols, the documents one after another, each from BEGIN to END. ``prefix[k]`` numbers the
    n-gram of the order before that each one goes on from. ``inside[k]`` marks the places that have enough symbols before.
    """

    starts: np.ndarray  # place of each document's BEGIN
    keys: list[np.ndarray]
    at: list[np.ndarray]
    prefix: list[np.ndarray]
    inside: list[np.ndarray]
    checks: np.ndarray  # 32 more bits of each distinct symbol


def grams(texts: list[bytes], order: int) -> Grams:
    """The n-grams of texts up to an order; A-Z count as lower case, words are what ASCII white space divides."""
    ids: dict[bytes, int] = {BEGIN: 0, END: 1}
    symbols, sizes = [], []
    for text in texts:
        words = text.lower().split()
        symbols.append(0)
        symbols += [ids.setdefault(w, len(ids)) for w in words]
        symbols.append(1)
        sizes.append(len(words) + 2)
    at = np.array(symbols, np.int64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64) if sizes else np.zeros(0, np.int64)
    since = np.arange(len(at)) - np.repeat(starts, sizes) if sizes else np.zeros(0, np.int64)
    halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in ids), "<u8").reshape(-1, 2)
    out = Grams(starts, [halves[:, 0]], [at], [np.zeros(len(ids), np.int64)], [since >= 0], halves[:, 1].astype(np.uint32))
    for k in range(1, order):
        before, inside = out.at[-1], since >= k
        place = np.flatnonzero(inside)
        pairs, which = np.unique(before[place - 1] * len(ids) + at[place], return_inverse=True)
        prefix, last = pairs // len(ids), pairs % len(ids)
        out.keys.append(mixed(out.keys[-1][prefix] * _MIX[2] + halves[last, 0] + np.uint64(k)))
        now = np.full(len(at), -1)
        now[place] = which
        out.at.append(now)
        out.prefix.append(prefix)
        out.inside.append(inside)
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1]


def expected_counts(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for level 0."""
    low = np.ldexp(1.0, np.maximum(level - 1, 0))
    return np.where(level > 0, (low + 2 * low - 1) / 2, 0.0)


def _places(keys: np.ndarray, level: int | np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of a cell of so many words that (key, level) sets bits in, and these bits."""
    own = mixed(keys + np.asarray(level, np.uint64) * _MIX[2])
    mask = np.zeros(len(own), np.uint64)
    for k in range(SET):
        mask |= np.uint64(1) << ((own >> np.uint64(6 * k)) & np.uint64(63))
    return (own >> np.uint64(6 * SET)) % words.astype(np.uint64), mask


def cell_filter(keys: np.ndarray, counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The 64-bit words of a cell that holds these n-grams."""
    level = levels(counts)
    words = np.zeros(max(1, -(-int(level.sum()) * bits // 64)), np.uint64)
    for j in range(1, int(level.max(initial=0)) + 1):
        own = keys[level >= j]
        where, mask = _places(own, j, np.array([len(words)]))
        np.bitwise_or.at(words, where.astype(np.int64), mask)
    return words


def cell_of(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cells of hashes; larger hashes are never in an earlier cell."""
    return ((keys >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)


class Filter:
    """Cells in a row."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words, self.sizes = words, sizes
        self.first = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by asking for one level after the other."""
        out = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        cell = cell_of(keys, len(self.sizes))
        for j in range(1, 65):
            where, mask = _places(keys[left], j, self.sizes[cell[left]])
            yes = (self.words[self.first[cell[left]] + where.astype(np.int64)] & mask) == mask
            left = left[yes]
            if not len(left):
                break
            out[left] = j
        return out


#: A word by 96 bits of it, with its count.
WORD = np.dtype([("key", "<u8"), ("check", "<u4"), ("n", "<u8")])


class Counts:
    """Exact counts of words, by 96 bits of each."""

    def __init__(self, keys: np.ndarray, checks: np.ndarray, numbers: np.ndarray):
        """Three arrays in the order of the keys."""
        self.keys, self.checks, self.numbers = keys, checks, numbers
        ends = np.flatnonzero(np.r_[keys[1:] != keys[:-1], True])
        self.most = int(np.diff(ends, prepend=-1).max(initial=1))  # words that share a key

    def of(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        if len(self.keys):
            at = np.searchsorted(self.keys, keys)
            for step in range(self.most):
                row = np.minimum(at + step, len(self.keys) - 1)
                out = np.where((self.keys[row] == keys) & (self.checks[row] == checks), self.numbers[row].astype(np.int64), out)
        return out


def _table(keys: np.ndarray, checks: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Rows of WORD, one for each word, by key."""
    order = np.lexsort((checks, keys))
    keys, checks, numbers = keys[order], checks[order], numbers[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])][: len(keys)])
    out = np.empty(len(first), WORD)
    out["key"], out["check"], out["n"] = keys[first], checks[first], np.add.reduceat(numbers, first) if len(first) else numbers
    return out


def _counted(found: Grams, cells: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(cell, word hashes with their counts, n-gram hashes, their counts) of documents."""
    keys, counts = list(found.keys), []
    for k in range(len(keys)):
        counts.append(np.bincount(found.at[k][found.inside[k]], minlength=len(keys[k])))
    words = _table(keys[0][1:], found.checks[1:], counts[0][1:])  # BEGIN is no token
    words = words[words["n"] > 0]
    every, number = np.concatenate(keys), np.concatenate(counts)
    every, number = every[number > 0], number[number > 0]
    order = np.argsort(cell_of(every, cells), kind="stable")
    every, number = every[order], number[order].astype("<u4")
    ends = np.searchsorted(cell_of(every, cells), np.arange(cells + 1))
    word_ends = np.searchsorted(cell_of(words["key"], cells), np.arange(cells + 1))
    for c in np.flatnonzero(np.diff(ends)):
        part = slice(ends[c], ends[c + 1])
        yield int(c), words[word_ends[c] : word_ends[c + 1]].tobytes(), every[part].tobytes(), number[part].tobytes()


def _added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, which = np.unique(keys, return_inverse=True)
    out = np.zeros(len(own), np.int64)
    np.add.at(out, which, counts.astype(np.int64))
    return own, out


def _joined(column: pa.ChunkedArray, kind: str | np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _by_cell(keys: np.ndarray, rows: np.ndarray, cells: int) -> tuple[list[int], list[bytes]]:
    """The cells that rows in the order of their keys fall in, and the rows of each: larger keys are never in an earlier cell."""
    cell = cell_of(keys, cells)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    ends = np.append(first[1:], len(keys))[: len(first)]
    return cell[first].tolist(), [rows[a:b].tobytes() for a, b in zip(first, ends, strict=True)]


def _cut(data: bytes, like: pa.ChunkedArray, size: int, width: int) -> pa.Array:
    """The answers to rows of questions, cut as these are: so many bytes a question, and an answer."""
    ends = np.r_[0, np.cumsum(pc.binary_length(like).to_numpy() // size * width)].tolist()
    return pa.array([data[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())


def _blocks(batch: pa.RecordBatch, column: int, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end, texts) of parts of a batch with about so much text."""
    texts: list[bytes] = []
    size = first = 0
    for n, x in enumerate(batch.column(column)):
        texts.append(x.as_py())
        size += len(texts[-1])
        if size >= most:
            yield first, n + 1, texts
            texts, size, first = [], 0, n + 1
    if texts:
        yield first, batch.num_rows, texts


@dataclass
class Model:
    """``cells``: rows (cell, filter, words), stored; n_tokens and n_words are the numbers of training tokens and of distinct ones."""

    cells: DataFrame
    n_cells: int
    n_bytes: int
    n_tokens: int
    n_words: int
    order: int


def learn(docs: DataFrame, text_col: str = "text", order: int = ORDER, bits: int = BITS) -> Model:
    """The model of all rows of ``docs``, with so many bits a pair. Counts are added up in each block of text, then cell by cell."""
    texts = docs.select(text_bytes(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    cells = int(size) // CELL_BYTES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        for batch in batches:
            for _, _, part in _blocks(batch, 0):
                rows = list(zip(*_counted(grams(part, order), cells), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["cell", "words", "grams", "counts"])

    def build(table: pa.Table) -> pa.Table:
        words = _joined(table.column("words"), WORD)
        exact = _table(words["key"], words["check"], words["n"])
        keys, counts = _added_up(_joined(table.column("grams"), "<u8"), _joined(table.column("counts"), "<u4"))
        data = cell_filter(keys, counts, bits).astype("<u8").tobytes()
        return pa.table({"cell": [table.column("cell")[0].as_py()], "filter": pa.array([data], pa.binary()), "words": pa.array([exact.tobytes()], pa.binary()), "n_tokens": pa.array([int(exact["n"].sum())], pa.int64())})

    parts = texts.mapInArrow(run, "cell long, words binary, grams binary, counts binary")
    own = materialize(parts.groupBy("cell").applyInArrow(build, "cell long, filter binary, words binary, n_tokens long"), "language-model")
    told = own.agg(F.sum(F.octet_length("filter") + F.octet_length("words")).alias("size"), F.sum("n_tokens").alias("n"), F.sum(F.octet_length("words") / WORD.itemsize).cast("long").alias("v")).first()
    return Model(own.select("cell", "filter", "words"), cells, int(told["size"] or 0), int(told["n"] or 0), int(told["v"] or 0), order)


def _loaded(cells: Iterable[tuple[int, bytes, bytes]], sizes: dict[int, tuple[int, int]], n_cells: int) -> tuple[Filter, Counts]:
    """Cells in any order, of whose filters and words the sizes in bytes are known. Those that aren't there hold nothing: one word without bits."""
    words = np.array([max(1, sizes.get(c, (0, 0))[0] // 8) for c in range(n_cells)], np.int64)
    rows = np.array([sizes.get(c, (0, 0))[1] // WORD.itemsize for c in range(n_cells)], np.int64)
    first, at = np.cumsum(words) - words, np.cumsum(rows) - rows
    bits, total = np.zeros(words.sum(), np.uint64), rows.sum()
    keys, checks, numbers = np.empty(total, np.uint64), np.empty(total, np.uint32), np.empty(total, np.uint64)
    for c, own, exact in cells:
        bits[first[c] : first[c] + words[c]] = np.frombuffer(own, "<u8")
        part, table = slice(at[c], at[c] + rows[c]), np.frombuffer(exact, WORD)
        keys[part], checks[part], numbers[part] = table["key"], table["check"], table["n"]
    small = numbers.max(initial=0) < 1 << 32
    return Filter(bits, words), Counts(keys, checks, numbers.astype(np.uint32) if small else numbers)


def log_scores(found: Grams, word_counts: np.ndarray, held: list[np.ndarray], n_tokens: int, n_words: int) -> pd.DataFrame:
    """For each document its number of tokens, of known ones, the exact unigram score and the model's, as log10.

    ``word_counts`` are exact, ``held`` the levels of the distinct n-grams of each order, all as the filter gives them. With
    c' the middle count of a level, P(w) = (c'(w) + 0.1) / (N + 0.1 (V + 1)) and, for longer histories h,
    P(w | h) = (min(c'(h w), c'(h)) + PRIOR * P(w | shorter h)) / (c'(h) + PRIOR).
    """
    all_mass = n_tokens + ADDED * (n_words + 1)
    token = found.at[0] != 0
    base = np.log10((word_counts + ADDED) / all_mass)[found.at[0]]
    own = [expected_counts(x) for x in held]
    p = np.minimum(1.0, (own[0] + ADDED) / all_mass)[found.at[0]]
    for k in range(1, len(own)):
        place = np.flatnonzero(found.inside[k])
        which = found.at[k][place]
        history = own[k - 1][found.prefix[k]]
        p[place] = (np.minimum(own[k], history)[which] + PRIOR * p[place]) / (history[which] + PRIOR)
    total = lambda x: np.add.reduceat(np.where(token, x, 0), found.starts) if len(found.starts) else x[:0]
    known = (word_counts > 0)[found.at[0]]
    return pd.DataFrame({"n_tokens": total(np.ones(len(token), np.int64)), "n_known": total(known.astype(np.int64)), "base_score": total(base), "score": total(np.log10(p))})


def _held(found: Grams, ask) -> list[np.ndarray]:
    """Levels of all n-grams, a longer one asked for only if the one that it goes on from is held."""
    held = [ask(found.keys[0])]
    for k in range(1, len(found.keys)):
        level = np.zeros(len(found.keys[k]), np.int64)
        some = np.flatnonzero(held[k - 1][found.prefix[k]] > 0)
        level[some] = ask(found.keys[k][some])
        held.append(level)
    return held


NAMES = ("n_tokens", "n_known", "base_score", "score")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None) -> DataFrame:
    """``(<id_col>, mark, n_tokens, n_known, base_score, score)``, a row for each row of ``docs``; see :func:`log_scores`.

    A null or empty text is its END alone; repeated rows and null ids pass as they are; ``mark`` is a column that is carried
    along (null if not given), other columns play no part.
    """
    mark = F.lit(None).cast("boolean") if mark is None else mark
    rows = docs.select(F.col(id_col).alias("id"), mark.alias("mark"), text_bytes(text_col).alias("text"))
    fields = [T.StructField("id", rows.schema["id"].dataType), T.StructField("mark", rows.schema["mark"].dataType)]
    schema = T.StructType([*fields, *(T.StructField(n, T.LongType() if n.startswith("n_") else T.DoubleType()) for n in NAMES)])
    out = (_scored_here if model.n_bytes <= BROADCAST_BYTES else _scored_by_shuffle)(rows, model, schema)
    return out.withColumnRenamed("id", id_col)


def _scored_here(rows: DataFrame, model: Model, schema: T.StructType) -> DataFrame:
    """With the cells broadcast: their size has been checked."""
    sizes = {r["cell"]: (r["f"], r["w"]) for r in model.cells.select("cell", F.octet_length("filter").alias("f"), F.octet_length("words").alias("w")).collect()}
    cells = ((r["cell"], r["filter"], r["words"]) for r in model.cells.toLocalIterator())
    sent = rows.sparkSession.sparkContext.broadcast(_loaded(cells, sizes, model.n_cells))
    order, n_tokens, n_words = model.order, model.n_tokens, model.n_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = sent.value
        for batch in batches:
            for first, end, texts in _blocks(batch, 2, BLOCK_BYTES // 2):
                found = grams(texts, order)
                scores = log_scores(found, counts.of(found.keys[0], found.checks), _held(found, own.level), n_tokens, n_words)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(scores[n]) for n in NAMES)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _scored_by_shuffle(rows: DataFrame, model: Model, schema: T.StructType) -> DataFrame:
    """With the cells where they are: the distinct n-grams of each block of documents go there, their levels and counts come back."""
    n_cells, order, n_tokens, n_words = model.n_cells, model.order, model.n_tokens, model.n_words
    numbered = rows.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_ROWS.bit_length() - 1))
    blocks = materialize(numbered, "blocks")

    def asked(table: pa.Table) -> pa.Table:
        found = grams([x.as_py() for x in table.column("text")], order)
        keys, words = np.unique(np.concatenate(found.keys)), _table(found.keys[0], found.checks, np.zeros(len(found.checks)))
        own, parts = _by_cell(keys, keys, n_cells)
        names = dict(zip(*_by_cell(words["key"], words, n_cells), strict=True))
        return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(own), pa.int64()), "cell": pa.array(own, pa.int64()), "keys": pa.array(parts, pa.binary()), "names": pa.array([names.get(c, b"") for c in own], pa.binary())})

    def answered(key: tuple, asking: pa.Table, cells: pa.Table) -> pa.Table:
        own = [(0, r["filter"], r["words"]) for r in cells.to_pylist()]
        levels_of, counts = _loaded(own, {c: (len(f), len(w)) for c, f, w in own}, 1)
        held = levels_of.level(_joined(asking.column("keys"), "<u8")).astype("<u1").tobytes()
        names = _joined(asking.column("names"), WORD)
        known = counts.of(names["key"], names["check"]).astype("<i8").tobytes()
        out = {"block": asking.column("block"), "cell": asking.column("cell")}
        return pa.table(out | {"held": _cut(held, asking.column("keys"), 8, 1), "counts": _cut(known, asking.column("names"), WORD.itemsize, 8)})

    def put(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        found = grams([x.as_py() for x in docs.column("text")], order)
        told = told.sort_by("cell")  # answers come without their questions, in the order of these
        keys, held = np.unique(np.concatenate(found.keys)), _joined(told.column("held"), "<u1").astype(np.int64)
        words = _table(found.keys[0], found.checks, np.zeros(len(found.checks)))
        counts = Counts(words["key"], words["check"], _joined(told.column("counts"), "<i8"))
        scores = log_scores(found, counts.of(found.keys[0], found.checks), _held(found, lambda k: held[np.searchsorted(keys, k)]), n_tokens, n_words)
        return pa.table({"id": docs.column("id"), "mark": docs.column("mark"), **{n: pa.array(scores[n]) for n in NAMES}})

    asking = blocks.groupBy("block").applyInArrow(asked, "block long, cell long, keys binary, names binary")
    told = asking.groupBy("cell").cogroup(model.cells.groupBy("cell")).applyInArrow(answered, "block long, cell long, held binary, counts binary")
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(put, schema)
