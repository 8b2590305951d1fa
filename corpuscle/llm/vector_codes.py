"""Product codes of vectors in whole numbers: codebooks by rounds of means, exact nearest entries by screening.

Distances of a block of parts to all entries of a codebook are first taken in float32, as one matrix product, with an
interval that rounding cannot leave; entries whose interval overlaps the best one's are computed again in int64, and ties
go to the lower index. So codes are exact, whatever the order in which the product adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import join_uneven, materialize

#: Whole numbers for 1.0, parts of a vector, entries of a codebook, rounds of means.
SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors whose distances to a codebook are held at a time.
BLOCK = 1 << 12
#: From this magnitude on sums of squares of wide parts could overflow int64: such blocks are computed in Python integers.
EXACT = 1 << 26
#: Base of the digits of sums.
DIGIT = 10**18
#: Unit roundoff of float32.
ROUNDOFF = 2.0**-24


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as whole numbers: int64, or Python integers where some don't fit it."""
    x = np.floor(np.asarray(values, np.float64) * scale) if np.abs(values).max(initial=0) < 2.0**1000 else np.array([[int(v) * scale for v in row] for row in values.tolist()], object)
    if x.dtype != object and np.abs(x).max(initial=0) < EXACT:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def screened(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector, entry) of all entries that may be the nearest one: their interval of distance overlaps the best one's.

    The float32 value of |c|^2 - 2 x.c differs from the true one by at most g (|c|^2 + 2 |x| |c|), where g = m u / (1 - m u)
    for m = width + 8 roundings at most (both factors, the products and sums in any order, the last two steps).
    """
    own, codes = x.astype(np.float32), entries.astype(np.float32)
    squares = np.einsum("ij,ij->i", entries, entries)
    values = (squares.astype(np.float32)[None, :] - np.float32(2) * (own @ codes.T)).astype(np.float64)
    steps = (x.shape[1] + 8) * ROUNDOFF
    lengths = np.sqrt(np.einsum("ij,ij->i", x, x).astype(np.float64))
    radius = (squares[None, :] + 2 * lengths[:, None] * np.sqrt(squares.astype(np.float64))[None, :]) * (steps / (1 - steps) * 1.0001)
    best = (values + radius).min(axis=1)
    return np.nonzero(values - radius <= best[:, None])


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of the nearest entry (ties: the lower one) and the squared distance, both exact."""
    if x.dtype == object or entries.dtype == object:  # no interval is narrow enough: all entries overlap
        x, entries = x.astype(object), entries.astype(object)
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(entries)) for v in x]
        return np.array([k for _, k in found], np.int64), np.array([d for d, _ in found] + [None], object)[:-1]
    row, entry = screened(x, entries)
    diff = x[row] - entries[entry]
    exact = np.einsum("ij,ij->i", diff, diff)
    if len(row) > len(x):
        order = np.lexsort((entry, exact, row))
        row, entry, exact = row[order], entry[order], exact[order]
        first = np.r_[True, row[1:] != row[:-1]]
        entry, exact = entry[first], exact[first]
    return entry, exact


def kept(vectors: DataFrame, id_col: str, vec_col: str, parts: int) -> DataFrame:
    """``(id, vec, ...)``: the rows with finite vectors of the commonest size, filled up with zeros to a multiple of parts."""
    wide = F.col(vec_col).cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite)
    sizes = usable.groupBy(F.size(vec_col).alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return usable.where("false").select(F.col(id_col).alias("id"), wide.alias("vec"), "*")
    size = sizes["size"]
    more = -size % parts
    filled = F.concat(wide, F.array_repeat(F.lit(0.0), more)) if more else wide
    return usable.where(F.size(vec_col) == size).select(F.col(id_col).alias("id"), filled.alias("vec"), "*")


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return scaled(flat.reshape(len(column), -1), scale)


def first_codebooks(rows: DataFrame, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """The parts of the rows with the smallest ids (of one id, the smaller vectors; null ids last), fewer if there are fewer rows."""
    top = rows.orderBy(F.asc_nulls_last("id"), "vec").select("vec").limit(entries).collect()
    if not top:
        return []
    return np.split(scaled(np.array([r["vec"] for r in top]), scale), parts, axis=1)


def _digits(number: int) -> list[int]:
    """Digits to the base DIGIT, lowest first; the last one carries the sign."""
    out = []
    while not -DIGIT < number < DIGIT:
        number, low = divmod(number, DIGIT)
        out.append(low)
    return [*out, number]


def means(rows: DataFrame, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floor of the mean of the parts nearest to it; unused entries stay.

    Every task sums what it reads; one row for each part and entry comes to the driver, as many as the codebooks have.
    A sum of any size goes as digits to the base 10^18, which Spark adds up as decimals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column(0).slice(at, BLOCK), scale)
                for p, own in enumerate(np.split(x, len(books), axis=1)):
                    code, _ = nearest(own, books[p])
                    counts[p] += np.bincount(code, minlength=len(counts[p]))
                    part = np.zeros(books[p].shape, own.dtype)
                    np.add.at(part, code, own)
                    sums[p] = sums[p] + part
        used = [(p, e, int(counts[p][e]), [_digits(int(v)) for v in sums[p][e]]) for p in range(len(books)) for e in range(len(books[p])) if counts[p][e]]
        yield pa.RecordBatch.from_arrays([pa.array([u[k] for u in used], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int64()))))], names=["part", "entry", "n", "sums"])

    partial = rows.select("vec").mapInArrow(run, "part int, entry int, n long, sums array<array<bigint>>")
    each = partial.select("part", "entry", "n", F.posexplode("sums").alias("at", "digits")).select("part", "entry", "n", "at", F.posexplode("digits").alias("k", "digit"))
    total = each.groupBy("part", "entry", "at", "k").agg(F.sum("n").alias("n"), F.sum(F.col("digit").cast("decimal(38,0)")).alias("s")).collect()
    all_sums: dict[tuple[int, int, int], int] = {}
    for r in total:
        key = (r["part"], r["entry"], r["at"])
        all_sums[key] = all_sums.get(key, 0) + int(r["s"]) * DIGIT ** r["k"]
    out = [b.astype(object) for b in books]
    for r in total:
        if r["k"] == 0:
            out[r["part"]][r["entry"], r["at"]] = all_sums[r["part"], r["entry"], r["at"]] // r["n"]
    return [b.astype(np.int64) if np.abs(b).max(initial=0) < EXACT else b for b in out]


def encoded(rows: DataFrame, books: list[np.ndarray], scale: int) -> DataFrame:
    """``(id, label, code, error)`` for rows (id, vec, label): indexes of the nearest entries, two hex digits each, and the sum of their squared distances."""
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField("id", kinds["id"]), T.StructField("label", kinds["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column(1), scale)
                codes, error = [], 0
                for p, own in enumerate(np.split(x, len(books), axis=1)):
                    code, distance = nearest(own, books[p])
                    codes.append(code)
                    error = error + distance
                text = [bytes(row).hex() for row in np.stack(codes, axis=1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(text, pa.string()), pa.array([str(e) for e in error], pa.string())], names=["id", "label", "code", "error"])

    out = rows.select("id", "vec", "label").mapInArrow(run, schema)
    return out.withColumn("error", F.expr("try_cast(error AS bigint)"))


def book_numbers(books: list[np.ndarray]) -> str:
    """All numbers of the codebooks by part, entry and position."""
    return ",".join(str(int(v)) for b in books for v in b.ravel())


def codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | Column = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``(<id_col>, code, error, label_error, codebooks)``, a row for each row of ``vectors`` that is kept.

    Components become floor(scale * x), vectors are cut into ``parts`` equal parts. error is the vector's squared distance to
    what its code stands for, label_error its sum over the rows of equal labels (nulls together), codebooks all numbers of
    the codebooks. Rows whose vector is null, empty, holds null or non-finite components, or isn't of the commonest size
    (of equally common ones, the smallest) are left out. A size that isn't a multiple of ``parts`` is filled up with zeros.
    Fewer rows than ``entries`` make smaller codebooks; repeated rows count as often as they are there; an error that is no
    64-bit integer is null. Codebooks are broadcast with the functions: ``entries`` vectors. At most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    plain = vectors.select(F.col(id_col).alias("i"), F.col(vec_col).alias("v"), (F.col(label_col) if isinstance(label_col, str) else label_col).alias("label"))
    rows = kept(plain, "i", "v", parts).select("id", "vec", "label")
    books = first_codebooks(rows, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = means(rows, books, scale)
    own = materialize(encoded(rows, books, scale) if books else rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), "vector-codes")
    named = own.select(F.col("label").isNull().alias("none"), F.coalesce(F.hash("label"), F.lit(0)).alias("mark"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("shown"), "id", "code", "error")
    keys = ["none", "mark", "shown"]
    sums = named.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("all"))
    sums = materialize(sums.select(*keys, "n", F.expr("try_cast(all AS bigint)").alias("label_error")), "label-errors")
    return join_uneven(named, sums, keys, own.count()).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(book_numbers(books)).alias("codebooks"))
