"""Digests and masking of text."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of credentials that must not be in a published file.
SECRETS = {
    "AWS access key": r"\bAKIA[0-9A-Z]{16}\b",
    "GitHub token": r"\b(?:ghp|github_pat)_[A-Za-z0-9_]{20,}\b",
    "Hugging Face token": r"\bhf_[A-Za-z0-9]{20,}\b",
    "OpenAI-style key": r"\bsk-[A-Za-z0-9]{20,}\b",
    "private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}


def sha256(content: Column) -> Column:
    """X23."""
    return F.sha2(content, 256)


def secrets(text: Column) -> Column:
    """Names of the credential shapes that a text holds."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SECRETS.items()]), lambda x: x.isNotNull())


def masked(text: Column, parts: list[str], mask: str = "***") -> Column:
    """Known substrings replaced, longer ones first."""
    return reduce(lambda t, p: F.replace(t, F.lit(p), F.lit(mask)), sorted(parts, key=len, reverse=True), text)


def masked_json(text: Column, pattern: str, mask: str = "***") -> Column:
    """What matches the pattern within the string values of a JSON text, in
    objects and arrays of any depth and in JSON texts within strings. Keys, numbers
    and the structure stay, so the result is JSON; other text is masked as text."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        found = re.compile(pattern)
        return texts.map(lambda t: None if t is None else _masked_text(t, found, mask))

    return run(text)


def _masked_text(text: str, found: re.Pattern, mask: str) -> str:
    if text.lstrip()[:1] in ("{", "["):
        try:
            return json.dumps(_masked_value(json.loads(text), found, mask), ensure_ascii=False)
        except (ValueError, RecursionError):
            pass
    return found.sub(mask, text)


def _masked_value(value: object, found: re.Pattern, mask: str) -> object:
    if isinstance(value, dict):
        return {k: _masked_value(v, found, mask) for k, v in value.items()}
    if isinstance(value, list):
        return [_masked_value(v, found, mask) for v in value]
    return _masked_text(value, found, mask) if isinstance(value, str) else value
