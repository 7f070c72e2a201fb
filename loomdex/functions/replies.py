"""Model replies: JSON found among other text, normalised symbols."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

SYMBOL = "struct<name:string,kind:string,line:int,purpose:string,behavior:string,parameters:string,returns:string,limitations:string>"
REPLY = f"struct<overview:string,symbols:array<{SYMBOL}>>"
BATCH_REPLY = f"map<string,{REPLY}>"
_FENCE = re.compile(r"\A```(?:json)?\s*|\s*```\s*\Z", re.I)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def _no_constant(name: str):
    raise ValueError(name)


def _loads(text: str):
    return json.loads(text, parse_constant=_no_constant)


def find_json(raw: str | None) -> str | None:
    """Compact JSON of a reply: the whole of it without code fences, else the first balanced object; else None."""
    if not raw:
        return None
    text = _FENCE.sub("", raw.strip())
    try:
        return json.dumps(_loads(text), separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        pass
    start, depth = text.find("{"), 0
    if start < 0:
        return None
    for token in _TOKEN.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(token[0], 0)
        if not depth:
            try:
                return json.dumps(_loads(text[start : token.end()]), separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None
    return None


@F.pandas_udf(StringType())
def extract_json(raw: pd.Series) -> pd.Series:
    return raw.map(find_json)


def normal_symbols(symbols: Column) -> Column:
    """Missing names and kinds become 'unknown', lines 0, texts empty; optional fields stay null."""
    return F.transform(
        F.coalesce(symbols, F.array().cast(f"array<{SYMBOL}>")),
        lambda s: F.struct(
            F.coalesce(s["name"], F.lit("unknown")).alias("name"), F.coalesce(s["kind"], F.lit("unknown")).alias("kind"),
            F.coalesce(s["line"], F.lit(0)).alias("line"), F.coalesce(s["purpose"], F.lit("")).alias("purpose"),
            F.coalesce(s["behavior"], F.lit("")).alias("behavior"), s["parameters"].alias("parameters"),
            s["returns"].alias("returns"), s["limitations"].alias("limitations"),
        ),
    )


def parse_reply(raw: Column) -> Column:
    """REPLY of a single-file reply; null if there is no JSON in it."""
    return F.from_json(extract_json(raw), REPLY)


def batch_entry(replies: Column, path: Column) -> Column:
    """The entry of a batch reply for ``path``: its own key, else the first key that ends with its base name, else null."""
    from loomdex.functions.text import basename

    ends = F.filter(F.map_entries(replies), lambda e: e["key"].endswith(basename(path)))
    return F.coalesce(F.try_element_at(replies, path), F.get(ends, F.lit(0))["value"])
