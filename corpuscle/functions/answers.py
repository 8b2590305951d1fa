"""Column functions that read what language models answer: lists, calls of tools; and settings of a run."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

CALL = "struct<name:string,arguments:string>"
# How calls stand in texts, in the order in which they are tried: whole blocks, blocks whose one tag is cut off, fences, bare objects.
BLOCK, CLOSED, OPEN = r"(?is)<tool_call>\s*(\{.*?\})\s*</tool_call>", r"(?is)(\{.*?\})\s*</tool_call>", r"(?is)<tool_call>\s*(\{.*\})\s*$"
FENCE, BARE = r"(?is)```(?:json)?\s*(\{.*?\})\s*```", r"(?s)(\{.*\})"


def json_list(value: Column) -> Column:
    """The JSON list of strings in an answer, with or without a fence; null without one."""
    return F.from_json(F.regexp_extract(F.coalesce(value, F.lit("")), r"(?s)(\[.*\])", 1), "array<string>")


def tool_calls(value: Column) -> Column:
    """Calls (name, arguments as JSON) in an answer, and how they stood there: ``struct<calls, source>``."""
    value = F.coalesce(value, F.lit(""))

    def calls(pattern: str, most: int | None = None) -> Column:
        found = F.regexp_extract_all(value, F.lit(pattern), F.lit(1))
        found = found if most is None else F.slice(found, 1, most)
        named = F.filter(F.transform(found, lambda x: F.from_json(x, CALL)), lambda c: F.coalesce(c["name"], F.lit("")) != "")
        return F.transform(named, lambda c: F.struct(c["name"].alias("name"), F.coalesce(F.when(c["arguments"].rlike(r"(?s)^\s*\{.*\}\s*$"), c["arguments"]), F.lit("{}")).alias("arguments")))

    tried = [("tool_call_block", calls(BLOCK)), ("tool_call_block", calls(CLOSED, 1)), ("tool_call_block", calls(OPEN, 1)), ("json_fence", calls(FENCE)), ("bare_json", calls(BARE, 1))]
    out = F.struct(F.array().cast("array<struct<name:string,arguments:string>>").alias("calls"), F.lit("empty").alias("source"))
    for source, found in reversed(tried):
        out = F.when(F.size(found) > 0, F.struct(found.alias("calls"), F.lit(source).alias("source"))).otherwise(out)
    return out


def merged_settings(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Settings with others laid over them, key by key at every depth; ``${NAME}`` and ``${NAME:-else}`` are filled in."""

    def filled(v: Any) -> Any:
        if isinstance(v, str):
            return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] or ""), v)
        return {k: filled(x) for k, x in v.items()} if isinstance(v, Mapping) else [filled(x) for x in v] if isinstance(v, list) else v

    def laid(a: Any, b: Any) -> Any:
        return {**a, **{k: laid(a[k], x) if k in a else x for k, x in b.items()}} if isinstance(a, Mapping) and isinstance(b, Mapping) else b

    return filled(laid(base, over))
