"""Response pages into items. Each parser takes pages (page_id, body, context) and returns one
row per item; ``parse_pages`` chooses it by provider and kind of page and has one outcome per
page, with the cursor of the next one. Bodies are dropped as soon as they are parsed; a body
that is no JSON, an unknown provider or an unknown kind fails its page and no other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.functions import text as X
from satchel.functions import trees as W

ITEM = ["external_id", "title", "poster_name", "poster_handle", "poster_bio", "publication", "summary", "url", "image", "bookmarked_at", "published_at", "kind", "duration", "collection", "stats"]
_TYPES = {"bookmarked_at": "long", "published_at": "long", "duration": "long", "collection": "array<string>", "stats": "map<string,string>"}


def item_columns(**given: Column) -> list[Column]:
    """All item columns: those given, and the blank of each other one."""
    out = []
    for c in ITEM:
        kind = _TYPES.get(c, "string")
        blank = F.lit("") if kind == "string" else F.array().cast(kind) if c == "collection" else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")) if c == "stats" else F.lit(None).cast(kind)
        out.append(given[c].cast(kind).alias(c) if c in given else blank.alias(c))
    return out


def _entries(pages: DataFrame, schema: str, entries: Callable[[Column], Column]) -> DataFrame:
    """(page_id, context, pos, e, j): the entries of each page's JSON."""
    parsed = pages.select("page_id", "context", F.from_json("body", schema).alias("j"))
    return parsed.select("page_id", "context", "j", F.posexplode(entries(F.col("j"))).alias("pos", "e"))


_IMAGES = "image_versions2: struct<candidates: array<struct<width: int, url: string>>>"
_MEDIA = f"pk: string, code: string, product_type: string, media_type: int, video_duration: double, taken_at: bigint, user: struct<username: string, full_name: string>, caption: struct<text: string>, saved_collection_ids: array<string>, {_IMAGES}, carousel_media: array<struct<{_IMAGES}>>"
INSTAGRAM = f"items array<struct<media: struct<{_MEDIA}>, {_MEDIA}>>, more_available boolean, next_max_id string"


def instagram(pages: DataFrame) -> DataFrame:
    """Saved posts. Names of collections come from the page's context."""
    rows = _entries(pages, INSTAGRAM, lambda j: j["items"])
    own = F.struct(*(F.col(f"e.{f}").alias(f) for f in ("pk", "code", "product_type", "media_type", "video_duration", "taken_at", "user", "caption", "saved_collection_ids", "image_versions2", "carousel_media")))
    m = rows.withColumn("m", F.coalesce("e.media", own)).where(X.or_else(F.col("m.pk")) != "")
    names = F.from_json(F.get_json_object("context", "$.collections"), "map<string,string>")
    lists = F.filter(F.transform(F.coalesce("m.saved_collection_ids", F.array().cast("array<string>")), lambda i: F.try_element_at(F.col("names"), i)), lambda n: F.coalesce(n, F.lit("")) != "")
    clips = F.coalesce(F.col("m.product_type") == "clips", F.lit(False))
    images = F.coalesce("m.image_versions2.candidates", F.get("m.carousel_media", F.lit(0))["image_versions2"]["candidates"])
    code = X.or_else(F.col("m.code"))
    return m.withColumn("names", F.coalesce(names, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))).select(
        "page_id", "pos",
        *item_columns(
            external_id=F.col("m.pk"), poster_name=X.or_else(F.col("m.user.full_name")), poster_handle=X.or_else(F.col("m.user.username")),
            summary=X.trim_all(X.or_else(F.col("m.caption.text"))), image=X.nearest_image(images), published_at=F.coalesce(F.col("m.taken_at") * 1000, F.lit(0)),
            url=F.when(code == "", "").otherwise(F.concat(F.lit("https://www.instagram.com/"), F.when(clips, "reel").otherwise("p"), F.lit("/"), code, F.lit("/"))),
            kind=F.when(clips, "reel").when(F.col("m.media_type") == 8, "carousel").when(F.col("m.media_type") == 2, "video").otherwise("post"),
            duration=F.floor(F.coalesce("m.video_duration", F.lit(0.0)) + 0.5), collection=lists,
        ),
    )


def instagram_collections(pages: DataFrame) -> DataFrame:
    """(page_id, id, name) of a collections page; the last of a repeated id wins."""
    rows = _entries(pages, "items array<struct<collection_id: string, collection_name: string>>", lambda j: j["items"])
    named = rows.where((X.or_else(F.col("e.collection_id")) != "") & (X.or_else(F.col("e.collection_name")) != ""))
    return named.groupBy("page_id", F.col("e.collection_id").alias("id")).agg(F.max_by("e.collection_name", "pos").alias("name"))


_POST = "id: string, title: string, subtitle: string, truncated_body_text: string, canonical_url: string, cover_image: string, post_date: string, type: string, podcast_duration: double, publishedBylines: array<struct<name: string>>"
_NOTE = "id: string, body: string, name: string, handle: string, author: struct<handle: string>, photo_url: string, date: string"
_SAVED = f"array<struct<post: struct<{_POST}>, comment: struct<{_NOTE}>, publication: struct<name: string>, saved_at: string, savedAt: string>>"
SUBSTACK = f"items {_SAVED}, nextCursor string, result struct<items: {_SAVED}, nextCursor: string>"


def date_ms(v: Column) -> Column:
    """Milliseconds of a number (as it is) or a date text; 0 if it is neither."""
    return F.coalesce(v.try_cast("long"), F.unix_millis(F.try_to_timestamp(v)), F.lit(0))


def substack(pages: DataFrame) -> DataFrame:
    """Saved posts and notes."""
    rows = _entries(pages, SUBSTACK, lambda j: F.coalesce(j["items"], j["result"]["items"]))
    post, note = F.col("e.post"), F.col("e.comment")
    is_post = post.isNotNull()
    byline, pub = X.or_else(F.get(post["publishedBylines"], F.lit(0))["name"]), X.or_else(F.col("e.publication.name"))
    handle = X.or_else(note["handle"], note["author"]["handle"])
    pick = lambda a, b: F.when(is_post, a).otherwise(b)
    note_url = F.concat(F.lit("https://substack.com"), F.when(handle != "", F.concat(F.lit("/@"), handle)).otherwise(""), F.lit("/note/c-"), note["id"])
    return rows.where(post.isNotNull() | note.isNotNull()).select(
        "page_id", "pos",
        *item_columns(
            external_id=pick(F.concat(F.lit("post:"), post["id"]), F.concat(F.lit("note:"), note["id"])), title=pick(F.coalesce(F.nullif(post["title"], F.lit("")), F.lit("Untitled post")), F.lit("")),
            poster_name=pick(byline, X.or_else(note["name"])), poster_handle=pick(F.lit(""), handle), publication=pick(F.when(pub != byline, pub).otherwise(""), F.lit("")),
            summary=pick(X.or_else(post["subtitle"], post["truncated_body_text"]), X.trim_all(X.or_else(note["body"]))), url=pick(X.or_else(post["canonical_url"]), note_url),
            image=pick(X.or_else(post["cover_image"]), X.or_else(note["photo_url"])), bookmarked_at=date_ms(F.coalesce("e.saved_at", "e.savedAt")),
            published_at=pick(date_ms(post["post_date"]), date_ms(note["date"])), kind=pick(F.coalesce(F.nullif(post["type"], F.lit("")), F.lit("post")), F.lit("note")),
            duration=pick(F.floor(F.coalesce(post["podcast_duration"], F.lit(0.0)) + 0.5), F.lit(None).cast("long")),
        ),
    )


_TMEDIA = "media: array<struct<type: string, media_url_https: string, video_info: struct<duration_millis: bigint>>>"
_USER = "core: struct<screen_name: string, name: string>, legacy: struct<screen_name: string, name: string, profile_image_url_https: string>, avatar: struct<image_url: string>"
_TWEET = f"rest_id: string, legacy: struct<full_text: string, created_at: string, entities: struct<urls: array<struct<url: string, expanded_url: string>>, {_TMEDIA}>, extended_entities: struct<{_TMEDIA}>>, note_tweet: struct<note_tweet_results: struct<result: struct<text: string>>>, core: struct<user_results: struct<result: struct<{_USER}>>>"
TWITTER = f"data struct<bookmark_timeline_v2: struct<timeline: struct<instructions: array<struct<type: string, entries: array<struct<content: struct<entryType: string, cursorType: string, value: string, itemContent: struct<tweet_results: struct<result: struct<{_TWEET}, tweet: struct<{_TWEET}>>>>>>>>>>>>"


def twitter(pages: DataFrame) -> DataFrame:
    """Bookmarked posts of the first add-entries instruction."""
    first = lambda j: F.get(F.filter(j["data"]["bookmark_timeline_v2"]["timeline"]["instructions"], lambda i: i["type"] == "TimelineAddEntries"), F.lit(0))["entries"]
    rows = _entries(pages, TWITTER, first)
    r = F.col("e.content.itemContent.tweet_results.result")
    own = F.struct(*(r[f].alias(f) for f in ("rest_id", "legacy", "note_tweet", "core")))
    cursor = (F.col("e.content.entryType") == "TimelineTimelineCursor") & (F.col("e.content.cursorType") == "Bottom")
    t = rows.where(~F.coalesce(cursor, F.lit(False))).withColumn("t", F.coalesce(r["tweet"], own)).where((X.or_else(F.col("t.rest_id")) != "") & F.col("t.legacy").isNotNull())
    user = F.col("t.core.user_results.result")
    t = t.withColumn("media", F.coalesce("t.legacy.extended_entities.media", "t.legacy.entities.media", F.from_json(F.lit("[]"), _TMEDIA.removeprefix("media: "))))
    has = lambda kind: F.exists("media", lambda m: m["type"] == kind)
    handle = X.or_else(user["core"]["screen_name"], user["legacy"]["screen_name"])
    text = X.or_else(F.col("t.note_tweet.note_tweet_results.result.text"), F.col("t.legacy.full_text"))
    picture = X.or_else(F.get("media", F.lit(0))["media_url_https"])
    millis = F.get(F.filter("media", lambda m: m["video_info"].isNotNull()), F.lit(0))["video_info"]["duration_millis"]
    return t.select(
        "page_id", "pos",
        *item_columns(
            external_id=F.col("t.rest_id"), poster_name=X.or_else(user["core"]["name"], user["legacy"]["name"]), poster_handle=handle, summary=X.expand_links(text, F.col("t.legacy.entities.urls")),
            url=F.concat(F.lit("https://x.com/"), F.when(handle == "", "i/web").otherwise(handle), F.lit("/status/"), F.col("t.rest_id")),
            image=F.when(picture != "", F.concat(picture, F.lit("?name=small"))).otherwise(X.or_else(user["avatar"]["image_url"], user["legacy"]["profile_image_url_https"])),
            published_at=F.coalesce(F.unix_millis(F.try_to_timestamp(F.substr("t.legacy.created_at", F.lit(5)), F.lit("MMM dd HH:mm:ss Z yyyy"))), F.lit(0)),
            kind=F.when(F.size("media") == 0, "tweet").when(has("video"), "video").when(has("animated_gif"), "gif").otherwise("photo"),
            duration=F.floor(F.coalesce(millis, F.lit(0)) / 1000 + 0.5),
        ),
    )


_TEXT = "struct<text: string>"
LINKEDIN = f"included array<struct<`$type`: string, entityUrn: string, trackingUrn: string, title: {_TEXT}, primarySubtitle: {_TEXT}, summary: {_TEXT}, navigationUrl: string, image: string>>, data struct<data: struct<searchDashClustersByAll: struct<metadata: struct<paginationToken: string>>>>"


def linkedin(pages: DataFrame) -> DataFrame:
    """Saved posts: the title is the poster. An entity without an id is named by its own hash."""
    rows = _entries(pages, LINKEDIN, lambda j: j["included"]).where(F.col("e")["$type"] == "com.linkedin.voyager.dash.search.EntityResultViewModel")
    return rows.select("page_id", "pos", *item_columns(
        external_id=F.coalesce(F.nullif(F.col("e.entityUrn"), F.lit("")), F.nullif(F.col("e.trackingUrn"), F.lit("")), F.sha2(F.to_json("e"), 256)), poster_name=X.or_else(F.col("e.title.text")),
        poster_bio=X.or_else(F.col("e.primarySubtitle.text")), summary=X.or_else(F.col("e.summary.text")), url=X.or_else(F.col("e.navigationUrl")), image=F.coalesce(W.image_url(F.col("e.image")), F.lit("")),
    ))


_ACTOR = "array<struct<name: string, url: string, profile_url: string>>"
_SAVABLE = f"struct<__typename: string, savable_title: string, savable_description: string, savable_permalink: string, url: string, savable_image: struct<uri: string>, playable_duration: double, savable_actors: {_ACTOR}, story: struct<actors: {_ACTOR}, owner_group: struct<name: string, full_name: string>>>"
FACEBOOK = f"edges array<struct<node: struct<id: string, savable: {_SAVABLE}, container_savable: {_SAVABLE}, story_pointer: struct<savable_image: struct<uri: string>>, containing_lists: struct<nodes: array<struct<name: string>>>>>>, page_info struct<end_cursor: string, has_next_page: boolean>"


def text_of(c: Column) -> Column:
    """A text, or the text field of an object given as JSON."""
    return F.when(F.startswith(c, F.lit("{")), F.coalesce(F.get_json_object(c, "$.text"), F.lit(""))).otherwise(F.coalesce(c, F.lit("")))


def facebook(pages: DataFrame) -> DataFrame:
    """Saved nodes of a connection."""
    rows = _entries(pages, FACEBOOK, lambda j: j["edges"]).where(F.col("e.node.id").isNotNull())
    s, box = F.col("e.node.savable"), F.col("e.node.container_savable")
    story = F.coalesce(box["story"], s["story"])
    actor = F.coalesce(F.get(box["savable_actors"], F.lit(0)), F.get(s["savable_actors"], F.lit(0)), F.get(story["actors"], F.lit(0)))
    group = F.coalesce(box["story"]["owner_group"], s["story"]["owner_group"])
    url, kind = X.or_else(s["savable_permalink"], s["url"]), F.lower(X.or_else(s["__typename"]))
    names = F.transform(F.coalesce("e.node.containing_lists.nodes", F.from_json(F.lit("[]"), "array<struct<name: string>>")), lambda n: n["name"])
    return rows.select("page_id", "pos", *item_columns(
        external_id=F.col("e.node.id"), publication=X.or_else(group["name"], group["full_name"]), poster_name=X.or_else(actor["name"]), poster_handle=X.profile_handle(X.or_else(actor["url"], actor["profile_url"])),
        summary=X.or_else(text_of(s["savable_title"]), text_of(s["savable_description"])), url=F.when(F.startswith(url, F.lit("/")), F.concat(F.lit("https://www.facebook.com"), url)).otherwise(url),
        image=X.or_else(s["savable_image"]["uri"], F.col("e.node.story_pointer.savable_image.uri")), kind=F.when(kind == "storypointer", "post").otherwise(kind),
        duration=F.floor(F.coalesce(s["playable_duration"], F.lit(0.0)) + 0.5), collection=F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""),
    ))


#: Class names of the parts of a Hacker News page (fixed values).
ROW, COMMENT, TITLE, SCORE, USER, SITE, AGE, BODY, MORE = "athing", "comtr", "titleline", "score", "hnuser", "sitestr", "age", "commtext", "morelink"
ORIGIN = "https://news.ycombinator.com"


def element(html: Column, tag: str, css: str | None = None) -> Column:
    """(attrs, inner) of the first ``tag`` in ``html``, or the first that has class ``css``: the
    text of its attributes, and what stands before the next end of such a tag. Both are empty
    if there is none."""
    has = "" if css is None else rf"(?=[^>]*\bclass=['\"](?:[^'\"]*\s)?{css}(?:\s[^'\"]*)?['\"])"
    pattern = rf"(?s)<{tag}\b{has}([^>]*)>(.*?)</{tag}>"
    return F.struct(F.regexp_extract(html, pattern, 1).alias("attrs"), F.regexp_extract(html, pattern, 2).alias("inner"))


def attribute(attrs: Column, name: str) -> Column:
    """The value of an attribute, entities as they are; empty if there is none."""
    double, single = (F.regexp_extract(attrs, rf"\b{name}={q}([^{q}]*){q}", 1) for q in "\"'")
    return X.or_else(double, single)


def text_nodes(html: Column) -> Column:
    """The texts between tags, hard spaces as spaces."""
    return F.transform(F.regexp_extract_all(html, F.lit(">([^<>]+)<"), F.lit(1)), lambda t: F.replace(t, F.lit("&nbsp;"), F.lit(" ")))


def age_ms(chunk: Column) -> Column:
    """The time in the title of an age: its number of seconds, else its date in UTC, else 0."""
    stamp = F.split(attribute(element(chunk, "span", AGE)["attrs"], "title"), " ")
    date, seconds = F.get(stamp, F.lit(0)), F.try_element_at(stamp, F.lit(2))
    utc = F.when(F.endswith(date, F.lit("Z")) | (date == ""), date).otherwise(F.concat(date, F.lit("Z")))
    return F.coalesce(F.when(F.length(seconds) > 8, seconds.try_cast("long")) * 1000, F.unix_millis(F.try_to_timestamp(utc)), F.lit(0))


def _rows(pages: DataFrame, comments: bool) -> DataFrame:
    """(page_id, pos, c, id): the table rows of a page that are entries of the wanted kind."""
    cut = F.split("body", rf"(?=<tr\b[^>]*\bclass=['\"]{ROW}\b)")
    rows = pages.select("page_id", F.posexplode(cut).alias("pos", "c")).withColumn("attrs", F.regexp_extract("c", r"^<tr\b([^>]*)>", 1))
    is_comment = F.array_contains(F.split(attribute(F.col("attrs"), "class"), " "), COMMENT)
    rows = rows.withColumn("id", F.regexp_extract(attribute(F.col("attrs"), "id"), r"^\d+", 0)).where("id <> ''")
    return rows.where(is_comment if comments else ~is_comment)


def _entry_url(number: Column) -> Column:
    return F.concat(F.lit(f"{ORIGIN}/item?id="), number)


def hackernews_stories(pages: DataFrame) -> DataFrame:
    """Upvoted stories of an HTML page; a row without a title link is left out."""
    rows = _rows(pages, comments=False)
    c = F.col("c")
    rows = rows.withColumn("link", element(element(c, "span", TITLE)["inner"], "a")).where(attribute(F.col("link.attrs"), "href") != "")
    points = X.int_after(element(c, "span", SCORE)["inner"], r"^\s*([\d,]+)\s+point")
    counted = F.get(F.filter(text_nodes(c), lambda t: t.rlike(r"^[\d,]+ comments?$")), F.lit(0))
    comments = X.int_after(F.coalesce(counted, F.lit("")), r"^([\d,]+)")
    stats = F.create_map(F.lit("points"), F.concat(points.cast("string"), F.lit(" points")), F.lit("comments"), F.concat(comments.cast("string"), F.lit(" comments")))
    return rows.select("page_id", "pos", *item_columns(
        external_id=F.col("id"), title=X.strip_tags(F.col("link.inner")), poster_handle=X.strip_tags(element(c, "a", USER)["inner"]), publication=element(c, "span", SITE)["inner"],
        url=_entry_url(F.col("id")), published_at=age_ms(c), kind=F.lit("story"), collection=F.array(F.lit("upvoted")), stats=stats,
    ))


def hackernews_comments(pages: DataFrame) -> DataFrame:
    """Upvoted comments of an HTML page; only rows that hold a comment's text."""
    c = F.col("c")
    rows = _rows(pages, comments=True).withColumn("body", element(c, "div", BODY)).where(F.contains(F.col("c"), F.lit(f'class="{BODY}')))
    parent = element(F.regexp_extract(c, r"(?s)\bon:\s*(<a\b.*)", 1), "a")
    of_entry = F.startswith(attribute(parent["attrs"], "href"), F.lit("item?id="))
    story = F.when(of_entry, X.or_else(X.decode_entities(attribute(parent["attrs"], "title")), X.strip_tags(parent["inner"]))).otherwise("")
    lines = F.regexp_replace(F.col("body.inner"), r"<(?:p|br\b[^>]*)>", "\n")
    return rows.select("page_id", "pos", *item_columns(
        external_id=F.col("id"), poster_handle=X.strip_tags(element(c, "a", USER)["inner"]), publication=F.when(story != "", F.concat(F.lit("on: "), story)).otherwise(""),
        summary=X.strip_tags(lines), url=_entry_url(F.col("id")), published_at=age_ms(c), kind=F.lit("comment"), collection=F.array(F.lit("upvoted")),
    ))


def next_page(html: Column, base: Column) -> Column:
    """The link to the next page against the page's own URL; null if there is none."""
    link = X.decode_entities(attribute(F.regexp_extract(html, rf"<a\b([^>]*\bclass=['\"]{MORE}['\"][^>]*)>", 1), "href"))
    origin, path = F.regexp_extract(base, r"^(\w+://[^/?#]+)", 1), F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(path == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    full = F.when(link.rlike(r"^\w+://"), link).when(F.startswith(link, F.lit("/")), F.concat(origin, link)).when(F.startswith(link, F.lit("?")), F.concat(path, link)).otherwise(F.concat(folder, link))
    return F.when(link != "", full)


def no_items(pages: DataFrame) -> DataFrame:
    """Pages that hold names, such as those of collections, but nothing saved."""
    return pages.limit(0).select("page_id", F.lit(0).alias("pos"), *item_columns())


# the next page

def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _instagram_next(pages: DataFrame) -> DataFrame:
    j = F.from_json("body", "more_available boolean, next_max_id string")
    return pages.select("page_id", F.when(j["more_available"], _given(j["next_max_id"])).alias("cursor"), F.lit(True).alias("more"))


def _substack_next(pages: DataFrame) -> DataFrame:
    j = F.from_json("body", "items array<string>, nextCursor string, result struct<nextCursor: string>")
    return pages.select("page_id", _given(F.when(j["items"].isNotNull(), j["nextCursor"]).otherwise(j["result"]["nextCursor"])).alias("cursor"), F.lit(None).cast("boolean").alias("more"))


def _twitter_next(pages: DataFrame) -> DataFrame:
    kind = "data struct<bookmark_timeline_v2: struct<timeline: struct<instructions: array<struct<type: string, entries: array<struct<content: struct<entryType: string, cursorType: string, value: string>>>>>>>>"
    steps = F.from_json("body", kind)["data"]["bookmark_timeline_v2"]["timeline"]["instructions"]
    entries = F.get(F.filter(steps, lambda i: i["type"] == "TimelineAddEntries"), F.lit(0))["entries"]
    ends = F.filter(entries, lambda e: (e["content"]["entryType"] == "TimelineTimelineCursor") & (e["content"]["cursorType"] == "Bottom"))
    return pages.select("page_id", _given(F.try_element_at(ends, F.lit(-1))["content"]["value"]).alias("cursor"), F.lit(None).cast("boolean").alias("more"))


def _linkedin_next(pages: DataFrame) -> DataFrame:
    token = F.get_json_object("body", "$.data.data.searchDashClustersByAll.metadata.paginationToken")
    return pages.select("page_id", _given(token).alias("cursor"), F.lit(None).cast("boolean").alias("more"))


def _facebook_next(pages: DataFrame) -> DataFrame:
    info = F.from_json("body", "page_info struct<end_cursor: string, has_next_page: boolean>")["page_info"]
    return pages.select("page_id", _given(info["end_cursor"]).alias("cursor"), F.coalesce(info["has_next_page"], F.lit(False)).alias("more"))


def _hackernews_next(pages: DataFrame) -> DataFrame:
    base = X.or_else(F.get_json_object("context", "$.url"), F.lit(ORIGIN))
    return pages.select("page_id", next_page(F.col("body"), base).alias("cursor"), F.lit(True).alias("more"))


def no_cursor(pages: DataFrame) -> DataFrame:
    """Pages after which none follows."""
    return pages.select("page_id", F.lit(None).cast("string").alias("cursor"), F.lit(True).alias("more"))


#: Services that page by offset: a page with items has a next one, with or without a cursor.
BY_OFFSET = ["linkedin"]
#: Kinds of pages that are known at all (fixed values); ``items`` stands for a service's main kind.
KINDS = ["items", "stories", "comments", "collections", "playlists", "connection"]

Parser = Callable[[DataFrame], DataFrame]
#: Parser and next-page function by provider and kind; kind null serves every known kind that
#: has no entry of its own.
_parsers: dict[tuple[str, str | None], tuple[Parser, Parser]] = {
    ("instagram", None): (instagram, _instagram_next), ("instagram", "collections"): (no_items, _instagram_next), ("substack", None): (substack, _substack_next),
    ("twitter", None): (twitter, _twitter_next), ("linkedin", None): (linkedin, _linkedin_next), ("facebook", None): (facebook, _facebook_next),
    ("hackernews", None): (hackernews_stories, _hackernews_next), ("hackernews", "comments"): (hackernews_comments, _hackernews_next),
}


def register_parser(provider: str, parser: Parser, kind: str | None = None, next_of: Parser = no_cursor) -> None:
    """Add a service, or replace its parser, for one kind of page or all; ``next_of`` gives
    (page_id, cursor, more): where the next page is, and whether there is one (null: if this
    one has items)."""
    _parsers[provider, kind] = (parser, next_of)


def parse_pages(pages: DataFrame, stored: Callable[[DataFrame], DataFrame] = lambda items: items) -> tuple[DataFrame, DataFrame]:
    """(items, outcomes) of ``pages`` (page_id, provider, body, context and, optionally, kind):
    items of all known providers, and per page the number of items, an error if there is one,
    the cursor of the next page and whether one follows. ``stored`` may write the items down,
    so that what uses them, the outcomes too, doesn't parse again."""
    kind = F.coalesce("kind", F.lit("items")) if "kind" in pages.columns else F.lit("items")
    of = pages.withColumn("kind_", kind)
    providers = sorted({p for p, _ in _parsers})
    known = F.col("kind_").isin(*KINDS, *(k for _, k in _parsers if k))
    html = F.col("provider") == "hackernews"
    bad = ~html & F.try_parse_json("body").isNull()
    error = (
        F.when(F.col("provider").isNull() | ~F.col("provider").isin(*providers), F.concat(F.lit("No parser for "), F.coalesce("provider", F.lit("null"))))
        .when(~known, F.concat(F.lit("No parser for pages of kind "), F.col("kind_"))).when(bad, "body is not JSON")
    )
    of = of.withColumn("error_", error)
    items = nexts = None
    for (provider, own_kind), (parser, next_of) in _parsers.items():
        others = [k for p, k in _parsers if p == provider and k]
        mine = F.col("kind_") == own_kind if own_kind else ~F.col("kind_").isin(*others) if others else F.lit(True)
        own = of.where((F.col("provider") == provider) & mine & F.col("error_").isNull())
        found, after = parser(own).withColumn("provider", F.lit(provider)), next_of(own)
        items, nexts = (found, after) if items is None else (items.unionByName(found), nexts.unionByName(after))
    items = stored(items)
    counts = items.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_items"))
    out = of.select("page_id", "provider", F.col("error_").alias("error")).join(counts, "page_id", "left").join(nexts, "page_id", "left")
    n = F.coalesce("n_items", F.lit(0))
    follows = F.col("error").isNull() & F.coalesce("more", n > 0) & (F.col("cursor").isNotNull() | F.col("provider").isin(*BY_OFFSET))
    return items, out.select("page_id", "provider", "error", n.alias("n_items"), "cursor", F.coalesce(follows, F.lit(False)).alias("has_next"))
