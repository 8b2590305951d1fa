"""BM25 scores where the chunks are: a chunk's words stay in one row, so no pair of question and chunk is ever shuffled.

A row has a chunk's words with their counts. A task scores its rows against all questions, as products of matrices for words
that many questions ask for and one by one for the others, and gives the k best of each question that it has seen. Only these
go on to the window that ranks them. Questions and weights of words are sent to the tasks, so they have to be few enough.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: BM25 constants, and digits to which scores are rounded before they are ranked.
K1, B, DIGITS = 1.5, 0.75, 5
#: Questions that are scored together at most, numbers in their matrix of weights and in one of scores, and questions from which on a word is one of the matrix.
COLUMNS, WEIGHTS, CELLS, SHARED = 256, 1 << 22, 1 << 21, 8
#: Words that are taken together, if they are of several rows.
WORDS = 1 << 19

TERMS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))


def _places(lists: pa.ListArray, size: int) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(size), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def _parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch whose lists have so many elements together, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right"))
        yield batch.slice(first, max(1, last - first))
        first = max(first + 1, last)


def counted(chunks: DataFrame, tokens: str, only: Sequence[str] | None = None) -> DataFrame:
    """The rows with ``dl`` and ``terms``, how many tokens they have and how often each, in place of a column of tokens; of ``terms`` those in ``only``, if given."""
    others = [f for f in chunks.schema if f.name != tokens]
    known = None if only is None else pa.array(only, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in _parts(b, len(others), WORDS)):
            lists = batch.column(len(others))
            flat, row = lists.flatten(), _places(lists, batch.num_rows)
            if known is None:
                coded = flat.dictionary_encode()
                code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
            else:
                code, words = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64), known
                row, code = row[code >= 0], code[code >= 0]
            width = max(1, len(words))
            each, tf = np.unique(row * width + code, return_counts=True)
            ends = np.searchsorted(each, np.arange(batch.num_rows + 1) * width)
            terms = pa.StructArray.from_arrays([words.take(pa.array(each % width)).cast(pa.string()), pa.array(tf.astype(np.int64))], ["term", "tf"])
            own = [batch.column(k) for k in range(len(others))]
            yield pa.RecordBatch.from_arrays([*own, pc.list_value_length(lists).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms)], names=[*(f.name for f in others), "dl", "terms"])

    schema = T.StructType([*others, T.StructField("dl", T.LongType()), T.StructField("terms", TERMS)])
    return chunks.select(*(f.name for f in others), tokens).mapInArrow(run, schema)


def narrowed(rows: DataFrame, only: Sequence[str]) -> DataFrame:
    """Counted rows with those of their ``terms`` that are in ``only``; rows without any go."""
    known, at = pa.array(only, pa.string()), rows.columns.index("terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            flat, row = lists.flatten(), _places(lists, batch.num_rows)
            held = pc.is_in(flat.field("term"), value_set=known)
            ends = np.searchsorted(row[held.to_numpy(zero_copy_only=False)], np.arange(batch.num_rows + 1))
            terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(held))
            own = pa.RecordBatch.from_arrays([terms if n == at else batch.column(n) for n in range(batch.num_columns)], names=batch.schema.names)
            yield own.filter(pa.array(np.diff(ends) > 0))

    return rows.mapInArrow(run, rows.schema)


def once_each(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counted rows with the same keys in one: their counts are added up. Without such rows the table as it is; only keys are shuffled to see that."""
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if twice.isEmpty():
        return rows
    same = [rows[c].eqNullSafe(twice[c]) for c in keys]
    flat = rows.join(twice, same, "left_semi").select(*keys, "dl", F.explode_outer("terms").alias("x"))
    each = flat.groupBy(*keys, "x.term").agg(F.first("dl").alias("dl"), F.sum("x.tf").alias("tf"))
    terms = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).cast(TERMS)
    return rows.join(twice, same, "left_anti").unionByName(each.groupBy(*keys).agg(F.first("dl").alias("dl"), terms.alias("terms")))


@dataclass(frozen=True)
class Questions:
    """Some questions and the words they ask for: ``ids`` of the questions, and for each word a row of weights, of the matrix if ``shared``, else as numbers ``at`` to the next in ``column`` and ``weight``."""

    ids: list
    terms: list[str]
    shared: np.ndarray  # for each word its row in the matrix, or -1
    matrix: np.ndarray
    at: np.ndarray
    column: np.ndarray
    weight: np.ndarray


def questions(asked: Sequence[tuple]) -> list[Questions]:
    """Blocks of questions, of (query_id, term, weight) in which each question has a term once."""
    by: dict = {}
    for q, term, w in asked:
        by.setdefault(q, []).append((term, w))
    blocks: list[list] = []
    entries = 0
    for q, own in by.items():
        if not blocks or len(blocks[-1]) >= COLUMNS or (entries + len(own)) * (len(blocks[-1]) + 1) > WEIGHTS:
            blocks.append([])
            entries = 0
        blocks[-1].append(q)
        entries += len(own)
    out = []
    for ids in blocks:
        terms = sorted({t for q in ids for t, _ in by[q]})
        number = {t: n for n, t in enumerate(terms)}
        row, column, weight = (np.array(x) for x in zip(*((number[t], c, w) for c, q in enumerate(ids) for t, w in by[q]), strict=True))
        order = np.argsort(row, kind="stable")
        row, column, weight = row[order], column[order], weight[order].astype(np.float64)
        at = np.searchsorted(row, np.arange(len(terms) + 1))
        many = np.flatnonzero(np.diff(at) > SHARED)
        shared = np.full(len(terms), -1)
        shared[many] = np.arange(len(many))
        matrix = np.zeros((len(many), len(ids)))
        held = shared[row] >= 0
        matrix[shared[row[held]], column[held]] = weight[held]
        out.append(Questions(ids, terms, shared, matrix, at, column, weight))
    return out


def _scores(own: Questions, row: np.ndarray, term: np.ndarray, part: np.ndarray, size: int) -> np.ndarray:
    """The score of each row for each question; 0 where they share no word."""
    width, place = len(own.ids), own.shared[term]
    dense = np.zeros((size, len(own.matrix)))
    of = place >= 0
    dense[row[of], place[of]] = part[of]
    out = dense @ own.matrix
    row, term, part = row[~of], term[~of], part[~of]
    times = own.at[term + 1] - own.at[term]
    which = np.repeat(own.at[term] - np.cumsum(times) + times, times) + np.arange(times.sum())
    cell = np.repeat(row, times) * width + own.column[which]
    out += np.bincount(cell, np.repeat(part, times) * own.weight[which], size * width).reshape(size, width)
    return out


def rounded(scores: np.ndarray) -> np.ndarray:
    """To DIGITS, halves away from zero."""
    return np.copysign(np.floor(np.abs(scores) * 10**DIGITS + 0.5) / 10**DIGITS, scores)


class Best:
    """The k best of each question among the rows seen so far: by rounded score, ties to the smaller key."""

    def __init__(self, own: Questions, k: int, key: pa.DataType):
        self.own, self.k = own, k
        self.kept = pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "key": pa.array([], key)})
        self.least = np.zeros(len(own.ids))

    def add(self, scores: np.ndarray, keys: pa.Array) -> None:
        floor, n = self.least, len(scores)
        if n > self.k and (scores > np.maximum(floor, 0.0)).sum() > 4 * self.k * len(floor):
            floor = np.maximum(floor, np.partition(scores, n - self.k, axis=0)[n - self.k])
        row, q = np.nonzero((scores > 0) & (scores >= floor - 2 * 10.0**-DIGITS))
        if not len(row):
            return
        new = pa.table({"q": q, "score": rounded(scores[row, q]), "key": keys.take(pa.array(row))})
        every = pa.concat_tables([self.kept, new])
        every = every.take(pc.sort_indices(every, sort_keys=[("q", "ascending"), ("score", "descending"), ("key", "ascending")], null_placement="at_start"))
        q = every["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.kept = every.filter(pa.array(place < self.k)).combine_chunks()
        last = np.flatnonzero(place == self.k - 1)
        self.least[q[last]] = every["score"].to_numpy()[last]


def best(rows: DataFrame, asked: Sequence[tuple], avgdl: float, k: int, query_type: T.DataType, key: str = "pk", askers: str | None = None) -> DataFrame:
    """``(query_id, key, score)``: of each task's counted rows the k best of each question, for ``asked`` (query_id, term, weight).

    A row counts only for the questions in its array ``askers``, if that is given. Rows have different keys.
    """
    blocks = questions(asked)
    schema = T.StructType([T.StructField("query_id", query_type), rows.select(key).schema[0], T.StructField("score", T.DoubleType())])
    names, id_type = schema.names, to_arrow_type(query_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: list[Best] = []
        for batch in (p for b in batches for p in _parts(b, 2, WORDS)):
            keys, lists, size = batch.column(0), batch.column(2), batch.num_rows
            every = every or [Best(own, k, keys.type) for own in blocks]
            flat, row = lists.flatten(), _places(lists, size)
            words, tf = flat.field("term"), flat.field("tf").to_numpy(zero_copy_only=False).astype(np.float64)
            dl = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl))
            for own, seen in zip(blocks, every, strict=True):
                term = pc.fill_null(pc.index_in(words, value_set=pa.array(own.terms, pa.string())), -1).to_numpy(zero_copy_only=False)
                of = term >= 0
                r, t, p = row[of], term[of], part[of]
                step = max(1, CELLS // (len(own.ids) + len(own.matrix)))
                for first in range(0, size, step):
                    n = min(step, size - first)
                    some = slice(*np.searchsorted(r, [first, first + n]))
                    scores = _scores(own, r[some] - first, t[some], p[some], n)
                    if askers is not None:
                        lists_of = batch.column(3).slice(first, n)
                        column = pc.fill_null(pc.index_in(lists_of.flatten(), value_set=pa.array(own.ids, lists_of.type.value_type)), -1).to_numpy(zero_copy_only=False)
                        asks = np.zeros(scores.shape, bool)
                        asks[_places(lists_of, n)[column >= 0], column[column >= 0]] = True
                        scores[~asks] = 0.0
                    seen.add(scores, keys.slice(first, n))
        for seen in every:
            kept = pa.table([pa.array(seen.own.ids, id_type).take(seen.kept["q"]), seen.kept["key"], seen.kept["score"]], names=names)
            yield from kept.combine_chunks().to_batches()

    return rows.select(key, "dl", "terms", *([askers] if askers else [])).mapInArrow(run, schema)
