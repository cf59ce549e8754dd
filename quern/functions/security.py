"""Guarding a model's input and output: cleaning, orders to a model, leaked prompts and their masking."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

# Characters without width, and what gives orders to a model.
INVISIBLE = [
    "\u200b", "\u200c", "\u200d", "\ufeff", "\u2060", "\u180e", "\u200e", "\u200f",
    "\u202a", "\u202b", "\u202c", "\u202d", "\u202e", "\u2066", "\u2067", "\u2068", "\u2069",
]
ORDERS = [
    r"ignore\s+(all\s+)?previous",
    r"disregard\s+(all\s+)?(above|previous)",
    r"forget\s+(\w+\s+)?instructions",
    r"system\s+prompt",
    r"new\s+instructions?",
    r"override\s+instructions?",
    r"you\s+are\s+now",
    r"act\s+as\s+if",
    r"pretend\s+(to\s+be|you\s+are)",
    r"from\s+now\s+on",
    r"ignore\s+everything",
    r"上記.{0,5}無視",
    r"指示(を|に)従(わ|う)な",
    r"新しい指示",
    r"システムプロンプト",
]
#: Characters of a model's input at most, and of a run that counts as leaked at least.
LONGEST, RUN = 4000, 20
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_INVISIBLE = re.compile("[" + "".join(INVISIBLE) + "]")
_ORDER = re.compile("|".join(ORDERS), re.I)


def extended(rows: DataFrame, more: dict) -> StructType:
    return StructType([*rows.schema.fields, *[StructField(k, t) for k, t in more.items()]])


def tag_pattern(prefix: str) -> re.Pattern:
    """Opening and closing tags of a session, which begin with the prefix."""
    return re.compile(rf"</?{re.escape(prefix)}[\s_-]*[A-Za-z0-9_-]*>", re.I)


def clean_text(t: str, prefix: str = "TASK", longest: int = LONGEST) -> tuple[str, bool, bool, int, list[str]]:
    """(clean, cut, tags removed, invisible characters removed, orders found) of one text."""
    t = html.unescape(unicodedata.normalize("NFKC", t))
    seen = _INVISIBLE.sub("", t)
    bare = tag_pattern(prefix).sub("", plain := _CONTROL.sub("", seen))
    orders = sorted({m[0] for m in _ORDER.finditer(bare)})
    return bare[:longest], len(bare) > longest, len(bare) < len(plain), len(t) - len(seen), orders


def clean_input(rows: DataFrame, text: str = "text", prefix: str = "TASK", longest: int = LONGEST) -> DataFrame:
    """Adds clean, cut, tags_removed, invisible_removed, orders, flagged (by orders or tags) to each row; all null for a null text."""
    more = {"clean": StringType(), "cut": BooleanType(), "tags_removed": BooleanType(), "invisible_removed": IntegerType(), "orders": ArrayType(StringType()), "flagged": BooleanType()}

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            got = [None if t is None else clean_text(t, prefix, longest) for t in p[text]]
            out = p.copy()
            for k, name in enumerate(list(more)[:5]):
                out[name] = pd.Series([None if g is None else g[k] for g in got], index=p.index, dtype=object)
            out["flagged"] = pd.Series([None if g is None else bool(g[4] or g[2]) for g in got], index=p.index, dtype=object)
            yield out

    return rows.mapInPandas(run, extended(rows, more))


def leaks(output: str, prompt: str, prefix: str = "TASK", run: int = RUN) -> tuple[list[str], list[str]]:
    """(parts of the output that the prompt holds, tags named in the output); parts are as long as can be, and do not overlap."""
    if not output or not prompt:
        return [], []
    tags = sorted(set(re.findall(rf"{re.escape(prefix)}[\s_-]*[A-Za-z0-9_-]{{4,}}", output, re.I)))
    low, of = output.lower(), prompt.lower()
    known = {of[i : i + run] for i in range(len(of) - run + 1) if of[i : i + run].strip()}
    parts, taken, i = [], 0, 0
    while i + run <= len(low):
        if i >= taken and low[i : i + run] in known:
            end = i + run
            while end < len(low) and end - i < len(of) and low[i : end + 1] in of:
                end += 1
            parts.append(output[i:end])
            i = taken = end
        else:
            i += 1
    return parts, tags


def mask_leaks(output: str, parts: list[str], tags: list[str], mask: str = "[REDACTED]") -> str:
    for x in [*tags, *parts]:
        output = re.sub(re.escape(x), lambda m: mask, output, flags=re.I)
    return output


def leaked(rows: DataFrame, text: str, prompt: str, prefix: str = "TASK", run: int = RUN) -> DataFrame:
    """Adds parts, tags and masked to each row: what its text gives away of the prompt, a column of it, and the text without."""
    more = {"parts": ArrayType(StringType()), "tags": ArrayType(StringType()), "masked": StringType()}

    def apply(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            got = [leaks(t or "", q or "", prefix, run) for t, q in zip(p[text], p[prompt], strict=True)]
            masked = [None if t is None else mask_leaks(t, *g) for t, g in zip(p[text], got, strict=True)]
            yield p.assign(parts=[g[0] for g in got], tags=[g[1] for g in got], masked=masked)

    return rows.mapInPandas(apply, extended(rows, more))
