"""Public preview pages of feeds, turned into posts and media."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class names and attributes of the preview page.
MESSAGE = "tgme_widget_message"
MESSAGE_TEXT = "tgme_widget_message_text"
MESSAGE_DATE = "tgme_widget_message_date"
PHOTO = "tgme_widget_message_photo_wrap"
VIDEO = "tgme_widget_message_video_player"
DURATION = "message_video_duration"
BUTTON = "tgme_widget_message_inline_button"
BUTTON_ROW = "tgme_widget_message_inline_row"
MORE = "tme_messages_more"
FEED_INFO = "tgme_channel_info"
BACKGROUND = r"background-image:\s*url\(['\"]?([^'\")]+)['\"]?\)"
POST_ID = r"/(\d+)(?:\?|$)"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

MEDIA = "array<struct<video: boolean, href: string, style: string, src: string, duration: string>>"
POST = f"struct<id: bigint, text: string, links: array<string>, date: string, buttons: int, media: {MEDIA}>"
PAGE = f"page_id bigint, title string, next_before bigint, posts array<{POST}>"


class _Node:
    def __init__(self, tag: str, attrs: dict, parent: _Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []
        self.classes = (attrs.get("class") or "").split()

    def walk(self) -> Iterator[_Node]:
        for child in self.children:
            if isinstance(child, _Node):
                yield child
                yield from child.walk()

    def having(self, *classes: str) -> Iterator[_Node]:
        return (n for n in self.walk() if any(c in n.classes for c in classes))

    def text(self) -> str:
        parts = []
        for child in self.children:
            if isinstance(child, str):
                parts.append(child)
            else:
                parts.append("\n" if child.tag == "br" else child.text())
        return "".join(parts)


class _Tree(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _first(nodes: Iterator[_Node]) -> _Node | None:
    return next(nodes, None)


def _media(message: _Node) -> list[dict]:
    out = []
    for a in message.having(PHOTO, VIDEO):
        if a.tag != "a":
            continue
        src = _first(n for n in a.walk() if n.tag == "video" and "src" in n.attrs)
        length = _first(n for n in a.having(DURATION) if n.tag == "time")
        out.append(
            {
                "video": PHOTO not in a.classes,
                "href": a.attrs.get("href") or a.attrs.get("data-single-url"),
                "style": a.attrs.get("style"),
                "src": src.attrs["src"] if src else None,
                "duration": length.text() if length else None,
            }
        )
    return out


def _page(html: str, feed: str) -> dict:
    root = _Tree(html or "").root
    head = _first(n for n in root.walk() if n.tag == "meta" and n.attrs.get("property") == "og:title")
    posts = []
    for m in root.having(MESSAGE):
        owner, _, number = (m.attrs.get("data-post") or "").partition("/")
        if m.tag != "div" or owner.lower() != feed.lower() or not number.isdigit():
            continue
        body = _first(m.having(MESSAGE_TEXT))
        times = [n for n in m.walk() if n.tag == "time" and "datetime" in n.attrs]
        keyed = {id(n) for d in m.having(MESSAGE_DATE) for n in d.walk()}
        time = next((n for n in times if id(n) in keyed), times[0] if times else None)
        in_rows = {id(n) for r in m.having(BUTTON_ROW) for n in r.walk() if n.tag == "a"}
        posts.append(
            {
                "id": int(number),
                "text": body.text().strip() if body else "",
                "links": [n.attrs["href"] for n in body.walk() if n.tag == "a" and "href" in n.attrs] if body else [],
                "date": time.attrs["datetime"] if time else None,
                "buttons": len(in_rows | {id(n) for n in m.having(BUTTON)}),
                "media": _media(m),
            }
        )
    more = _first(n for n in root.having(MORE) if n.attrs.get("data-before", "").isdigit())
    before = int(more.attrs["data-before"]) if more else None
    if before is None and posts:
        before = min(p["id"] for p in posts)
        before = before if before > 1 else None
    return {"title": (head.attrs.get("content") or "").strip() if head else "", "next_before": before, "posts": posts}


def page_to_posts(pages: DataFrame) -> DataFrame:
    """``page_id, title, next_before, posts`` from pages ``page_id, feed, html``.

    Posts of other feeds are dropped.  Only the walk over the markup runs in
    Python; everything after it is columns.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                {"page_id": i, **_page(h, f)} for i, f, h in zip(pdf["page_id"], pdf["feed"], pdf["html"], strict=True)
            ]
            out = pd.DataFrame(rows, columns=["page_id", "title", "next_before", "posts"])
            yield out.astype({"next_before": "Int64"})

    return pages.select("page_id", "feed", "html").mapInPandas(parse, PAGE)


def posts_of(parsed: DataFrame) -> DataFrame:
    """One row per post, the date as an instant (NULL when unreadable)."""
    posts = parsed.select("page_id", F.explode("posts").alias("p"))
    return posts.select(
        "page_id", F.col("p.id").alias("post_id"), "p.text", "p.links", "p.buttons",
        F.try_to_timestamp("p.date").alias("posted_at"), "p.media",
    )


def parse_duration(col: str | Column) -> Column:
    """Seconds from ``h:mm:ss`` or ``m:ss``; NULL for anything else."""
    text = F.trim(F.col(col) if isinstance(col, str) else col)
    parts = F.transform(F.split(text, ":"), lambda p: p.cast("bigint"))
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 60 + p)
    return F.when(text.rlike(r"^\d+(:\d+)*$"), total)


def posts_to_media(posts: DataFrame) -> DataFrame:
    """``page_id, post_id, item_id, kind, url, duration``, one row per media item.

    A photo is taken from its background picture (none, no item); a video
    without a source is ``too_big``.
    """
    rows = posts.select("page_id", "post_id", F.explode("media").alias("m"))
    number = F.nullif(F.regexp_extract("m.href", POST_ID, 1), F.lit("")).cast("bigint")
    photo = F.nullif(F.regexp_extract("m.style", BACKGROUND, 1), F.lit(""))
    video = F.col("m.video")
    return rows.select(
        "page_id",
        "post_id",
        F.coalesce(number, F.col("post_id")).alias("item_id"),
        F.when(~video, "photo").when(F.col("m.src").isNull(), "too_big").otherwise("video").alias("kind"),
        F.when(~video, photo).otherwise(F.coalesce("m.src", F.lit(""))).alias("url"),
        F.when(video, parse_duration("m.duration")).alias("duration"),
    ).filter("url is not null")


def has_preview(html: str | Column) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    return h.contains(FEED_INFO) | h.contains(MESSAGE)
