"""Walks over JSON of no fixed shape, a page at a time; what they find is projected by Spark."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Containers of suggestions, lists of rows, and the mark of a suggestion section.
SHELVES = {"horizontalShelfViewModel", "shelfRenderer", "richShelfRenderer"}
LISTS = {"contents", "continuationItems"}
SUGGESTED = "RECOMMENDATION"
ROW = "playlistVideoRenderer"
DEEPEST, DEEPEST_IMAGE = 24, 8


def get(x: Any, *path: str) -> Any:
    """The value at a path of keys; None where a step is missing."""
    for key in path:
        x = x.get(key) if isinstance(x, dict) else None
    return x


def walk(root: Any, children: Callable[[Any], list[tuple[Any, bool]]], deepest: int = DEEPEST) -> Iterator[Any]:
    """Hits in document order. ``children`` lists a node's children, each with whether it is a
    hit; hits are not entered."""
    stack = [(root, 0, False)]
    while stack:
        x, depth, hit = stack.pop()
        if hit:
            yield x
        elif isinstance(x, (dict, list)) and depth <= deepest:
            stack += [(y, depth + 1, h) for y, h in reversed(children(x))]


def under(key: str, closed: set[str] = frozenset()) -> Callable:
    """Children for all values of ``key`` outside of ``closed`` keys."""
    return lambda x: [(y, False) for y in x] if isinstance(x, list) else [(v, k == key) for k, v in x.items() if k not in closed]


def list_rows(x: Any) -> list[tuple[Any, bool]]:
    """Children for video rows that stand directly in a list, outside of suggestions."""
    if isinstance(x, list):
        return [(y, False) for y in x]
    out = []
    for k, v in x.items():
        style = get(v, "header", "itemSectionHeaderRenderer", "titleStyle")
        if k in SHELVES or (k == "itemSectionRenderer" and isinstance(style, str) and SUGGESTED in style):
            continue
        if k in LISTS and isinstance(v, list):
            out += [(get(y, ROW), True) if get(y, ROW) else (y, False) for y in v]
        else:
            out.append((v, False))
    return out


def token_in(entries: Any) -> str | None:
    """Token of a continuation that stands directly in a list."""
    tokens = (get(y, "continuationItemRenderer", "continuationEndpoint", "continuationCommand", "token") for y in (entries if isinstance(entries, list) else ()))
    return next((t for t in tokens if t), None)


def next_token(page: Any) -> str | None:
    """Where the list of videos goes on: the token in a video list, else in an appended batch
    that has a real row. Tokens of suggestions are passed over."""
    lists = [get(x, "contents") for x in walk(page, under("playlistVideoListRenderer", SHELVES))]
    batches = [get(x, "continuationItems") for x in walk(page, under("appendContinuationItemsAction", SHELVES))]
    lists += [b for b in batches if isinstance(b, list) and any(get(y, ROW, "videoId") for y in b)]
    return next((t for t in map(token_in, lists) if t), None)


def playlist_titles(page: Any) -> list[tuple[str, Any]]:
    """(id, title node) of a feed's playlists; later ones replace earlier ones."""
    grid = [(get(x, "playlistId"), get(x, "title")) for x in walk(page, under("gridPlaylistRenderer"))]
    lockups = [x for x in walk(page, under("lockupViewModel")) if get(x, "contentType") == "LOCKUP_CONTENT_TYPE_PLAYLIST"]
    return [(i, t) for i, t in grid + [(get(x, "contentId"), get(x, "metadata", "lockupMetadataViewModel", "title")) for x in lockups] if i]


def parsed(body: str | None) -> Any:
    try:
        return json.loads(body or "")
    except ValueError:
        return None


def image_in(root: Any, target: int = 100) -> str:
    """The first vector image in an object: its root and the artifact nearest in width."""
    stack = [(root, 0)]
    while stack:
        x, depth = stack.pop()
        if not isinstance(x, (dict, list)) or depth > DEEPEST_IMAGE:
            continue
        base, artifacts = get(x, "rootUrl"), get(x, "artifacts")
        if isinstance(base, str) and isinstance(artifacts, list) and artifacts:
            best = min(artifacts, key=lambda a: abs((get(a, "width") or 0) - target))
            if get(best, "fileIdentifyingUrlPathSegment"):
                return base + get(best, "fileIdentifyingUrlPathSegment")
        stack += [(v, depth + 1) for v in reversed(x if isinstance(x, list) else list(x.values()))]
    return ""


@F.pandas_udf(T.StringType())
def image_url(images: pd.Series) -> pd.Series:
    """``image_in`` for JSON texts; null and broken ones give an empty text."""
    return images.map(lambda s: image_in(parsed(s)) if s else "")
