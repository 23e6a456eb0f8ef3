"""Playlist pages into video items. A page's nesting is not fixed, so a small helper walks each
body for its rows and its next token; everything else is column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.functions import text as X
from satchel.functions import trees as W
from satchel.operators import parsing as P

NODE = "struct<simpleText: string, runs: array<struct<text: string>>, content: string>"
VIDEO = f"videoId string, isPlayable boolean, title {NODE}, shortBylineText {NODE}, videoInfo {NODE}, lengthSeconds string, thumbnail struct<thumbnails: array<struct<width: int, url: string>>>, thumbnailOverlays array<struct<thumbnailOverlayTimeStatusRenderer: struct<style: string>>>, navigationEndpoint struct<commandMetadata: struct<webCommandMetadata: struct<url: string>>>"
#: Characters of pages whose rows are handed on together.
CHUNK = 1 << 20
ORIGIN = "https://www.youtube.com"
#: Fixed ids of the lists every account has: one is always offered, one never.
WATCH_LATER, LIKED = ("WL", "Watch later"), "LL"


def node_text(t: Column) -> Column:
    """Text of a node: the plain one, else its runs joined, else its content."""
    runs = F.array_join(F.transform(t["runs"], lambda r: F.coalesce(r["text"], F.lit(""))), "")
    return X.or_else(t["simpleText"], runs, t["content"])


def scanned(pages: DataFrame) -> DataFrame:
    """(page_id, rows array<string>, cursor) of ``pages`` (page_id, body); broken bodies have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, chars = [], 0
            for i, body in zip(b.page_id, b.body, strict=True):  # one page's tree at a time
                tree = W.parsed(body)
                out.append((i, [json.dumps(r) for r in W.walk(tree, W.list_rows)], W.next_token(tree)))
                chars += len(body or "")
                if chars > CHUNK:
                    yield pd.DataFrame(out, columns=["page_id", "rows", "cursor"])
                    out, chars = [], 0
            if out:
                yield pd.DataFrame(out, columns=["page_id", "rows", "cursor"])

    return pages.select("page_id", "body").mapInPandas(run, "page_id long, rows array<string>, cursor string")


def youtube(pages: DataFrame) -> DataFrame:
    """Videos of playlist pages (page_id, body, context and, for publication dates, fetched_at);
    rows that can't be played or have no id are left out."""
    fetched = F.timestamp_millis("fetched_at") if "fetched_at" in pages.columns else F.lit(None).cast("timestamp")
    context = pages.select(F.col("page_id").alias("p_"), F.get_json_object("context", "$.collection").alias("list_"), fetched.alias("at_"))
    rows = scanned(pages).select("page_id", F.posexplode("rows").alias("pos", "row"))
    v = rows.select("page_id", "pos", F.from_json("row", VIDEO).alias("v")).where((X.or_else(F.col("v.videoId")) != "") & F.coalesce("v.isPlayable", F.lit(True)))
    v = v.join(context, F.col("page_id") == F.col("p_"))
    shorts = F.coalesce(F.exists("v.thumbnailOverlays", lambda o: F.coalesce(o["thumbnailOverlayTimeStatusRenderer"]["style"] == "SHORTS", F.lit(False))), F.lit(False))
    short = shorts | F.startswith(X.or_else(F.col("v.navigationEndpoint.commandMetadata.webCommandMetadata.url")), F.lit("/shorts/"))
    stats = X.split_stats(node_text(F.col("v.videoInfo")))
    return v.withColumns({"short": short, "stats_": stats}).select("page_id", "pos", *P.item_columns(
        external_id=F.col("v.videoId"), title=node_text(F.col("v.title")), poster_name=node_text(F.col("v.shortBylineText")), stats=F.col("stats_"),
        url=F.concat(F.lit(ORIGIN), F.when(F.col("short"), "/shorts/").otherwise("/watch?v="), F.col("v.videoId")), image=X.nearest_image(F.col("v.thumbnail.thumbnails")),
        published_at=F.when(F.col("stats_")["age"].isNotNull(), X.published_estimate(F.col("stats_")["age"], F.col("at_"))).otherwise(F.lit(0)),
        kind=F.when(F.col("short"), "short").otherwise("video"), duration=F.coalesce(F.regexp_extract(X.or_else(F.col("v.lengthSeconds")), r"^\s*(\d+)", 1).try_cast("long"), F.lit(0)),
        collection=F.when(X.or_else(F.col("list_")) != "", F.array("list_")).otherwise(F.array().cast("array<string>")),
    ))


def cursors(pages: DataFrame) -> DataFrame:
    """(page_id, cursor, has_next) of playlist pages."""
    return scanned(pages).select("page_id", "cursor", F.col("cursor").isNotNull().alias("has_next"))


def playlists(pages: DataFrame) -> DataFrame:
    """(page_id, id, title) of playlist feeds; a repeated id keeps its last title, one without a
    title is named by its id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, str(x), json.dumps(t)) for i, body in zip(b.page_id, b.body, strict=True) for k, (x, t) in enumerate(W.playlist_titles(W.parsed(body)))]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "id", "node"])

    found = pages.select("page_id", "body").mapInPandas(run, "page_id long, pos int, id string, node string")
    title = X.or_else(node_text(F.from_json("node", NODE)), F.col("id"))
    return found.groupBy("page_id", "id").agg(F.max_by(title, "pos").alias("title"))


def offered(lists: DataFrame, pages: DataFrame) -> DataFrame:
    """``playlists`` of each of ``pages`` with the list of later videos, without the liked ones."""
    later = pages.select("page_id").distinct().select("page_id", F.lit(WATCH_LATER[0]).alias("id"), F.lit(WATCH_LATER[1]).alias("title"))
    own = lists.where(~F.col("id").isin(LIKED, WATCH_LATER[0]))
    return own.unionByName(later)


def _next(pages: DataFrame) -> DataFrame:
    return cursors(pages).select("page_id", "cursor", F.lit(True).alias("more"))


P.register_parser("youtube", youtube, next_of=_next)
P.register_parser("youtube", P.no_items, "playlists")
