"""Benchmark decontamination: containment search by size-partitioned MinHash sketches, then an exact check.

The sketch of a test item is the least hashes of its word shingles (a bottom-k MinHash). A document that holds a share s
of an item's n shingles misses at most n - ceil(s n) of them, so of the n - ceil(s n) + 1 least it holds one at least:
with sketches of that size the search loses no pair, however long the document. Items are partitioned by the size of
their shingle sets, by powers of two. A partition has a bound, the greatest hash in any of its sketches, and a least size
of the documents that can hold one of its items. The sketch of a document is its shingles under the greatest bound of
the partitions that it is large enough for: the others can't meet a sketch and go no further. Candidates are checked by
their shingles as words, not as hashes. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, text_id

#: Bytes of a table of (item, shingle) that may be broadcast; above it the joins shuffle by shingle.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _each(text: Column, width: int, shorter: Sequence[int], shown, none: str) -> Column:
    """``shown`` of each run of ``width`` words of a text, and of each run of as many as ``shorter`` says.

    Fewer words than the width make one run, none make none. The words are bound to a lambda variable, so that they are
    split once for a text and not once for each run.
    """

    def of(own: Column) -> Column:
        def runs_of(n: int, last: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), last), lambda i: shown(own, i, n))

        runs = [runs_of(width, F.greatest(F.size(own) - width, F.lit(0)))]
        runs += [F.when(F.size(own) >= n, runs_of(n, F.size(own) - n)).otherwise(F.array().cast(none)) for n in shorter]
        return F.when(F.size(own) > 0, F.concat(*runs)).otherwise(F.array().cast(none))

    return F.get(F.transform(F.array(words(text)), of), F.lit(0))


def shingles(text: Column, width: int, shorter: Sequence[int] = ()) -> Column:
    """Hashes of a text's word shingles."""
    return _each(text, width, shorter, lambda own, i, n: F.xxhash64(*(F.get(own, i + k) for k in range(n))), "array<bigint>")


def shingle_words(text: Column, width: int, shorter: Sequence[int] = ()) -> Column:
    """A text's word shingles themselves, words joined by spaces."""
    return _each(text, width, shorter, lambda own, i, n: F.array_join(F.slice(own, i + 1, n), " "), "array<string>")


def _bounded(table: DataFrame, size: Column) -> DataFrame:
    """The table with a broadcast hint if the counted sum of its rows' sizes is within the bound."""
    return F.broadcast(table) if (table.agg(F.sum(size + 32)).first()[0] or 0) <= BROADCAST_BYTES else table


def _least(share: float, n: Column) -> Column:
    """The fewest of n shingles that make the share; the small term keeps products like 0.8 * 5 whole."""
    return F.ceil(F.lit(share) * n - 1e-9)


def contained(docs: DataFrame, items: DataFrame, share: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(<id_col>, <item_id>, n_shared, n_item, containment)`` for every document with ``share`` of an item's shingles.

    Texts are compared as sets of shingles of ``width`` words. An item with fewer words is one shingle of all its words,
    sought among the shingles of as many words of every document; null, empty and wordless texts match nothing. Rows that share an id are judged by themselves and give
    a row for each text that matches; repeated rows give one. Null ids match like any other. Other columns play no part.
    """
    # hashes of a text of n < width words are those of its n words: xxhash64 of a null word leaves the hash as it is
    size = F.size(words(F.col(item_text)))
    shorter = sorted(r[0] for r in items.select(size.alias("n")).where(F.col("n").between(1, width - 1)).distinct().collect())  # width - 1 at most
    texts_of = F.array_distinct(shingle_words(F.col(item_text), width))
    own = items.select(F.col(item_id).alias("item"), F.array_distinct(shingles(F.col(item_text), width)).alias("s"), texts_of.alias("w"))
    own = materialize(own.where(F.size("s") > 0).withColumn("n", F.size("w")).withColumn("needs", _least(share, F.col("n"))).distinct(), "items")
    # hashes that collide would make fewer of them than shingles: the sketch still holds one too many to be missed
    sketch_size = (F.col("n") - F.col("needs") + 1).cast("int")
    ordered = F.array_sort(F.transform("s", lambda h: F.struct(F.xxhash64(h).alias("o"), h.alias("h"))))
    sketch = own.select("item", "needs", F.floor(F.log2("n")).cast("int").alias("part"), F.inline(F.slice(ordered, F.lit(1), sketch_size)))
    sketch = materialize(sketch, "sketches")
    parts = sketch.groupBy("part").agg(F.max("o").alias("bound"), F.min("needs").alias("needs")).collect()  # one row for a power of two

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    bound = F.greatest(F.lit(-(1 << 63)), *(F.when(F.size("s") >= r["needs"], F.lit(r["bound"])) for r in parts)) if parts else F.lit(-(1 << 63))
    # bound to a generated column, so that the shingles are made once and not again for each use
    hashed = texts.select(*text_id(F.col("text")), F.explode(F.array(shingles(F.col("text"), width, shorter))).alias("s"))
    under = F.filter(F.transform("s", lambda h: F.struct(F.xxhash64(h).alias("o"), h.alias("h"))), lambda x: x["o"] <= F.col("top"))
    seen = hashed.withColumn("size", F.size("s")).withColumn("top", bound).select("t1", "t2", "size", F.inline(under))
    small = _bounded(sketch.select("item", "needs", "h"), F.lit(0))
    found = materialize(seen.select("t1", "t2", "size", "h").join(small, "h").where(F.col("size") >= F.col("needs")).select("t1", "t2", "item").distinct(), "candidates")

    named = texts.withColumns({c: e for c, e in zip(("t1", "t2"), text_id(F.col("text")), strict=True)})
    near = named.join(found.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi")
    near = near.select("id", "t1", "t2", F.explode(shingle_words(F.col("text"), width, shorter)).alias("w"))
    known = own.select("item", "n", "needs", F.explode("w").alias("w"))
    shared = near.join(_bounded(known, F.octet_length("w")), "w").select("id", "t1", "t2", "item", "n", "needs", "w").distinct()
    shared = shared.groupBy("id", "t1", "t2", "item", "n", "needs").agg(F.count("*").alias("n_shared")).where("n_shared >= needs")
    sought = found.select("t1", "t2", F.col("item").alias("sought"))
    exact = shared.join(sought, [shared.t1 == sought.t1, shared.t2 == sought.t2, F.col("item").eqNullSafe(F.col("sought"))], "left_semi")
    return exact.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "n_shared", F.col("n").cast("long").alias("n_item"), F.round(F.col("n_shared") / F.col("n"), 6).alias("containment"), "t1", "t2")


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The pairs of :func:`contained` alone, without the names of the texts."""
    return contained(docs, items, **options).drop("t1", "t2")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns as they were; null and empty texts stay."""
    bad = contained(docs, items, text_col=text_col, **options).select("t1", "t2").distinct()
    t1, t2 = text_id(F.col(text_col))
    return docs.join(bad, (t1 == bad.t1) & (t2 == bad.t2), "left_anti")


SQL = r"""
WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') w FROM (SELECT DISTINCT doc_id, text FROM documents) t),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, text, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) s FROM d WHERE len(w) > 0
 UNION SELECT doc_id, text, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) FROM d JOIN (SELECT DISTINCT len(w) n FROM i WHERE len(w) BETWEEN 1 AND 4) short ON len(w) >= n),
iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) s FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) n_item FROM iw GROUP BY item_id),
m AS (SELECT doc_id, text, item_id, count(*) n_shared FROM ds JOIN iw USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment
FROM m JOIN n USING (item_id) WHERE n_shared >= ceil(0.8::DOUBLE * n_item - 1e-9)
"""
