"""Nested payloads kept as JSON text: work of any depth that built-in functions on fixed paths can't say."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that only tell how a value was come by: fixed values.
DIAGNOSTIC_KEYS = ("error", "errors", "message", "cost_usd", "total_cost", "scraped_at", "_scraped_at")
#: Keys of payloads that hold no data of the product: fixed values.
STAMPS = ("scraped_at", "_scraped_at")
_IMAGE_KEY = re.compile("image|img|photo|picture|thumbnail|gallery|hero", re.IGNORECASE)
_IMAGE_ADDRESS = re.compile(r"(?:https?:/)?/.*(?:\.(?:png|jpe?g|webp|gif|bmp|svg)(?:[?#]|$)|image|img|photo|picture|thumbnail|cdn)", re.IGNORECASE | re.DOTALL)


def parsed(v: str | None):
    try:
        return json.loads(v) if v is not None else None
    except ValueError:
        return None


def without(v, keys: frozenset):
    if isinstance(v, dict):
        return {k: without(x, keys) for k, x in v.items() if k.lower() not in keys}
    return [without(x, keys) for x in v] if isinstance(v, list) else v


def without_keys(payload: Column, keys: tuple[str, ...] = DIAGNOSTIC_KEYS) -> Column:
    """The payload without entries of the keys, at any depth and in any case; null where it does not parse."""
    names = frozenset(keys)

    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series) -> pd.Series:
        nodes = (parsed(v) for v in texts)
        return pd.Series([None if n is None else json.dumps(without(n, names), separators=(",", ":"), ensure_ascii=False) for n in nodes], dtype=object)

    return clean(payload)


def texts_of(v, under_image: bool = False, depth: int = 0, most_depth: int = 6):
    """(text, does a key on its way name images?) of a payload's texts, in order, down to a depth."""
    if depth > most_depth:
        return
    if isinstance(v, str):
        yield v.strip(), under_image
    elif isinstance(v, list):
        for x in v:
            yield from texts_of(x, under_image, depth + 1, most_depth)
    elif isinstance(v, dict):
        for k, x in v.items():
            if k.lower() not in STAMPS:
                yield from texts_of(x, under_image or bool(_IMAGE_KEY.search(k)), depth + 1, most_depth)


def is_image(text: str, under_image: bool) -> bool:
    """Addresses that look like an image's, and embedded images under an image's key."""
    return bool(_IMAGE_ADDRESS.match(text)) or (under_image and text.lower().startswith("data:image/"))


def image_candidates(payload: Column, most: int = 24, most_depth: int = 6) -> Column:
    """The first `most` distinct image addresses of a payload in order; none where it does not parse."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def collect(texts: pd.Series) -> pd.Series:
        found = (dict.fromkeys(x for x, key in texts_of(parsed(v), most_depth=most_depth) if is_image(x, key)) for v in texts)
        return pd.Series([list(f)[:most] for f in found], dtype=object)

    return collect(payload)
