"""Byte-pair encoding with public tokenizer files: encoding, decoding and token counts.

Merging keeps the symbols of a pre-token in a doubly linked list and the candidate merges in a priority queue by rank,
then place; entries whose symbols have changed since are skipped. The tokenizer file is a parameter: each Python worker
reads it once, so it must be installed on every machine.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import text_bytes

#: Pre-tokens whose result a worker keeps, and the longest that it keeps: bounds of its memory.
KEPT, KEPT_CHARS = 300_000, 64


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


class Tokenizer:
    """A byte-level BPE tokenizer read from a tokenizers JSON file.

    Supported: a ByteLevel pre-tokenizer with its own pattern or a Split before it; NFC, whitespace replacement and
    lower case as normalizers; an end-of-word suffix; added tokens that are matched as they stand.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in reversed([*enumerate(pairs)])}
        self.chars, suffix = byte_chars(), model.get("end_of_word_suffix") or ""
        self.first = [self.vocab[c] for c in self.chars]
        self.last = [self.vocab[c + suffix] for c in self.chars]
        self.suffix = suffix
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        kinds = [n["type"] for n in _parts(spec["normalizer"], "normalizers")]
        if unknown := {*kinds} - {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normalizers not supported: {unknown}")
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        steps = _parts(spec["pre_tokenizer"], "pretokenizers")
        own = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
        self.pattern = regex.compile(own or r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        back = {c: b for b, c in enumerate(self.chars)}
        self.strings = [b""] * (1 + max(*self.vocab.values(), *self.added.values(), 0))
        for token, i in self.vocab.items():
            word = token.removesuffix(suffix) if suffix else token
            self.strings[i] = bytes(back[c] for c in word) + (b" " if suffix and word != token else b"")
        for token, i in self.added.items():
            self.strings[i] = token.encode()

    def merge(self, token: bytes) -> list[int]:
        """The ids of one pre-token."""
        ids = [self.first[b] for b in token]
        if not ids:
            return ids
        ids[-1] = self.last[token[-1]]
        n, ranks = len(ids), self.ranks
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        queue = []
        for i in range(n - 1):
            if found := ranks.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of its symbols is gone or has grown
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if found := ranks.get((new, ids[after[i]])):
                    heapq.heappush(queue, (found[0], i, new, ids[after[i]], found[1]))
            if (p := before[i]) >= 0 and (found := ranks.get((ids[p], new))):
                heapq.heappush(queue, (found[0], p, ids[p], new, found[1]))
        return [x for x in ids if x >= 0]

    def segments(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """(id of an added token, []) or (None, pre-tokens of the text between two of them), in order."""
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            if m.start() > at:
                yield None, self._pretokens(text[at : m.start()])
            yield self.added[m[0]], []
            at = m.end()
        if at < len(text):
            yield None, self._pretokens(text[at:] if at else text)

    def _pretokens(self, text: str) -> list[str]:
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # each character by itself: no final sigma
        return self.pattern.findall(text)

    def whole_tokens(self) -> set[str]:
        """The pre-tokens that are vocabulary strings and that merging proves to be one token alone."""
        out = set()
        for token, i in self.vocab.items():
            if self.suffix and not token.endswith(self.suffix):
                continue
            word = self.strings[i].removesuffix(b" ") if self.suffix else self.strings[i]
            if self.merge(word) == [i]:
                try:
                    out.add(word.decode())
                except UnicodeDecodeError:
                    continue  # part of a character: never a pre-token
        return out


def _parts(step: dict | None, name: str) -> list[dict]:
    return [] if step is None else step[name] if step["type"] == "Sequence" else [step]


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    """The tokenizer at this path, once for each Python process."""
    return Tokenizer(path)


class _Packed(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers; forgets all when it holds too many."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, token: str) -> bytes:
        packed = np.array(self.tokenizer.merge(token.encode()), "<u4").tobytes()
        if len(token) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[token] = packed
        return packed


class _Counts(dict):
    """Pre-token to its number of tokens: 1 for the whole tokens, by merging for the rest."""

    def __init__(self, tokenizer: Tokenizer, whole: Iterable[str]):
        self.tokenizer, self.whole = tokenizer, dict.fromkeys(whole, 1)
        self.update(self.whole)

    def __missing__(self, token: str) -> int:
        n = len(self.tokenizer.merge(token.encode()))
        if len(token) <= KEPT_CHARS:
            if len(self) >= KEPT + len(self.whole):
                self.clear()
                self.update(self.whole)
            self[token] = n
        return n


@lru_cache(maxsize=4)
def _packed(path: str) -> _Packed:
    return _Packed(load(path))


def encode_text(path: str, text: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    packed = _packed(path)
    return b"".join(b"".join(map(packed.__getitem__, tokens)) if i is None else i.to_bytes(4, "little") for i, tokens in load(path).segments(text))


def decode_ids(path: str, ids: bytes) -> str:
    """The text of ids: their vocabulary strings in a row; ids outside the vocabulary count as empty."""
    strings = load(path).strings
    numbers = np.frombuffer(ids, "<u4")
    if len(numbers) and int(numbers.max()) >= len(strings):
        numbers = numbers[numbers < len(strings)]
    return b"".join(map(strings.__getitem__, numbers.tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """``(<id_col>, ids, n_tokens)``, a row for each row of ``docs``; ids are little-endian unsigned 32-bit integers.

    A null or empty text has no tokens; special tokens' strings in a text become their ids; nothing is truncated.
    Repeated rows and null ids pass as they are; other columns play no part. ``decoded`` names one more column: the text
    of the ids, as :func:`decode` gives it, made by the same Python worker (a second step would have one more of them).
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    schema = T.StructType(fields if decoded is None else [*fields, T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode_text(path, str(x.as_py(), "utf-8", "replace")) for x in batch.column(1)]
            columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if decoded is not None:
                columns.append(pa.array([decode_ids(path, x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col), text_bytes(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with one more column: the text of its ids. Null ids give an empty text."""
    rest = [c for c in encoded.columns if c != text_col]
    schema = T.StructType([*(encoded.schema[c] for c in rest), T.StructField(text_col, T.StringType())])
    at = rest.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(path, x.as_py() or b"") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(*(F.col(f"`{c}`") for c in rest)).toDF(*(f"c{k}" for k in range(len(rest)))).mapInArrow(run, schema)  # plain names on the way


@lru_cache(maxsize=4)
def proved(path: str) -> tuple[str, ...]:
    """The vocabulary's strings that encode alone as one token, in order: proved once for a tokenizer and process."""
    return tuple(sorted(load(path).whole_tokens()))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_bytes, n_tokens, over_limit)``, a row for each row of ``docs``.

    The whole tokens are proved offline, before any text is read (see :func:`proved`), and broadcast: their number is at
    most the vocabulary's. A null or empty text has no tokens; repeated rows and null ids pass as they are; other columns
    play no part.
    """
    whole = docs.sparkSession.sparkContext.broadcast(proved(path))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        counts = _Counts(tokenizer, whole.value)
        for batch in batches:
            size, found = [], []
            for x in batch.column(1):
                raw = x.as_py()
                size.append(len(raw))
                found.append(sum(1 if i is not None else sum(map(counts.__getitem__, tokens)) for i, tokens in tokenizer.segments(str(raw, "utf-8", "replace"))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(found, pa.int64()), pa.array([n > limit for n in found], pa.bool_())], names=schema.names)

    return docs.select(F.col(id_col), text_bytes(text_col).alias("text")).mapInArrow(run, schema)
