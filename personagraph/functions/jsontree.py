"""Embedded page state: small Arrow helpers for what column functions cannot reach."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STATE = re.compile(r'window\.__INITIAL_STATE__\s*=\s*JSON\.parse\("((?:[^"\\]|\\.)*)"', re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)
_LD = re.compile(r'<script[^>]*type="application/ld\+json"[^>]*>\s*(.*?)\s*</script>', re.S)
_LEFT_OVER = re.compile(r"\\u([0-9a-fA-F]{4})")


def _valid(text: str | None) -> str | None:
    try:
        json.loads(text)
    except (TypeError, ValueError, RecursionError):  # nested deeper than the reader goes
        return None
    return text


def _state_text(page: str | None) -> str | None:
    hit = _STATE.search(page or "")
    if hit is None:
        return None
    # Only the quote, apostrophe and backslash escapes belong to the script literal.
    return _valid(_ESCAPE.sub(lambda m: m[1] if m[1] in "\"'\\" else m[0], hit[1]))


@F.pandas_udf(T.StringType())
def page_state(page: pd.Series) -> pd.Series:
    """JSON text of the state a page embeds as a script string literal."""
    return page.map(_state_text)


def _nodes(root):
    """Every object of a document, parents before children, in document order, however deep."""
    waiting = [root]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            yield node
            waiting += reversed(node.values())
        elif isinstance(node, list):
            waiting += reversed(node)


def find_key(key: str):
    """Column function: JSON text of the first value other than null stored under ``key`` anywhere in a document."""

    def look(text: str | None) -> str | None:
        if not text or _valid(text) is None:
            return None
        for node in _nodes(json.loads(text)):
            if node.get(key) is not None:
                return json.dumps(node[key], ensure_ascii=False)
        return None

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(look)

    return run


def _plain(text: str | None) -> str | None:
    return None if text is None else _LEFT_OVER.sub(lambda m: chr(int(m[1], 16)), text)


def _image_of(node: dict) -> str | None:
    image = node.get("image")
    if isinstance(image, dict):
        image = image.get("contentUrl")
    return image if isinstance(image, str) and image else None


def _linked_data(page: str | None) -> dict:
    roots = [json.loads(t) for t in _LD.findall(page or "") if _valid(t) is not None]
    own = [r for r in roots if isinstance(r, dict) and "mainEntity" in r] or roots
    found = {"name": None, "description": None, "image": None}
    links: dict[str, None] = {}
    for root in own:
        for node in _nodes(root):
            for field in ("name", "description"):
                if found[field] is None and isinstance(node.get(field), str) and node[field]:
                    found[field] = node[field]
            found["image"] = found["image"] or _image_of(node)
            same = node.get("sameAs")
            for url in same if isinstance(same, list) else []:
                if isinstance(url, str):
                    links.setdefault(url)
    return {**{k: _plain(v) for k, v in found.items()}, "same_as": [_plain(u) for u in links]}


LINKED_DATA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name", "description", "image")]
    + [T.StructField("same_as", T.ArrayType(T.StringType()))]
)


@F.pandas_udf(LINKED_DATA)
def linked_data(page: pd.Series) -> pd.DataFrame:
    """Name, description, image and links a page states about itself as linked data."""
    return pd.DataFrame([_linked_data(p) for p in page], columns=["name", "description", "image", "same_as"])
