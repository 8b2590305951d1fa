"""Runs of words that repeat with a period, found by power-of-two naming and taken down to one period.

Karp, Miller and Rosenberg: level k names every stretch of 2^k words, equal stretches alike, from the pairs of names of
its halves. How far two places of a text go on alike, to the right or to the left, follows by descending the levels. A run
of period q and length of at least max(24, 3 q) matches itself q words on over 2 h(q) words or more, so it holds a whole
cell of a grid of width h(q); cells that match are extended to both sides by the names. The grids of all periods together
have about n log n cells. No hash and no suffix order is used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import text_bytes

#: The shortest run, and the least number of periods in it.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Grid cells that are looked at together.
CELLS = 1 << 18
#: Words before their rewriting, with the row's id, to words.
Rewrite = Callable[[object, list[bytes]], list[bytes]]


def levels(names: np.ndarray) -> list[np.ndarray]:
    """Names of all stretches of 1, 2, 4, ... words; the last level is the first on which no name repeats, or the longest."""
    out = [names]
    width = 1
    while 2 * width <= len(names) and int(out[-1].max()) + 1 < len(out[-1]):
        own = out[-1].astype(np.int64)
        pairs = own[:-width] * (int(own.max()) + 1) + own[width:]
        out.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
        width *= 2
    return out


def ahead(named: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For places i < j the number of words from them on that are alike."""
    i, j, n = i.copy(), j.copy(), len(named[0])
    first = i.copy()
    for k in range(len(named) - 1, -1, -1):
        fits = np.flatnonzero(j + (1 << k) <= n)
        fits = fits[named[k][i[fits]] == named[k][j[fits]]]
        i[fits] += 1 << k
        j[fits] += 1 << k
    return i - first


def behind(named: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For places i < j the number of words before them that are alike."""
    i, j = i.copy(), j.copy()
    first = i.copy()
    for k in range(len(named) - 1, -1, -1):
        fits = np.flatnonzero(i >= 1 << k)
        fits = fits[named[k][i[fits] - (1 << k)] == named[k][j[fits] - (1 << k)]]
        i[fits] -= 1 << k
        j[fits] -= 1 << k
    return first - i


def runs(words: list[bytes]) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    n = len(words)
    none = np.empty((0, 3), np.int64)
    if n < LEAST_WORDS:
        return none
    seen: dict[bytes, int] = {}
    names = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, n)
    named = levels(names)
    periods = np.arange(1, n // LEAST_PERIODS + 1)
    least = np.maximum(LEAST_WORDS, LEAST_PERIODS * periods)
    width = (least - periods) // 2  # of 2 * width words or more that match, some whole cell is among them
    level = np.floor(np.log2(width)).astype(np.int64)
    usable = level < len(named)
    if not usable.any():
        return none
    counts = np.where(usable, np.maximum(0, (n - periods) // width), 0)
    found = []
    ends = np.cumsum(counts)
    at = 0
    while at < len(periods):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
        own = np.repeat(np.arange(at, to), counts[at:to])
        before = ends[at:to] - counts[at:to]
        place = (np.arange(len(own)) - np.repeat(before - (ends[at - 1] if at else 0), counts[at:to])) * width[own]
        for k in np.unique(level[at:to]):
            if k >= len(named):
                continue
            mine = level[own] == k
            i, which = place[mine], own[mine]
            q = periods[which]
            far = i + width[which] - (1 << k)  # a cell is as wide as two stretches of its level that overlap
            alike = (named[k][i] == named[k][i + q]) & (named[k][far] == named[k][far + q])
            i, q, need = i[alike], q[alike], least[which[alike]]
            if not len(i):
                continue
            back = behind(named, i, i + q)
            length = back + ahead(named, i, i + q) + q
            long = length >= need
            found.append(np.stack([i - back, length, q], axis=1)[long])
        at = to
    if not found or not (total := np.concatenate(found)).size:
        return none
    total = total[np.lexsort((total[:, 2], total[:, 1], total[:, 0]))]
    first = np.r_[True, (total[1:, :2] != total[:-1, :2]).any(axis=1)]  # of the periods of one stretch the smallest
    total = total[first]
    return total[np.lexsort((total[:, 2], total[:, 0]))]


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 0] + found[:, 1], -1)
    return np.cumsum(step[:-1]) == 0


def strongest(found: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest length by its period; ties go to the smallest start, then period."""
    return min((tuple(map(int, r)) for r in found), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """``(<id_col>, runs, best, collapsed)``, a row for each row of ``docs``.

    runs: array of (start, length, period) in words, by start, then period; best: the one of the greatest length / period
    (null without a run); collapsed: the words that stay, joined by one space. Words are what ASCII white space divides; a
    null or empty text has none and an empty collapsed text. ``rewrite`` changes the words of a row, by its id, before they
    are looked at. Rows are taken one by one: repeated rows and null ids pass as they are, other columns play no part, and
    memory is about 4 n log2(n) bytes for n words, less where no long stretches repeat.
    """
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("runs", T.ArrayType(run)), T.StructField("best", run), T.StructField("collapsed", T.StringType())])
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_runs, best, texts = [], [], []
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                words = data.as_py().split()
                if rewrite:
                    words = rewrite(key.as_py(), words)
                found = runs(words)
                top = strongest(found)
                all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()])
                best.append(None if top is None else dict(zip(("start", "length", "period"), top, strict=True)))
                if top is not None:
                    words = [words[i] for i in np.flatnonzero(kept(len(words), found))]
                texts.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(all_runs, pa.list_(kind)), pa.array(best, kind), pa.array(texts, pa.string())], names=schema.names)

    return docs.select(F.col(id_col), text_bytes(text_col).alias("text")).mapInArrow(each, schema)
