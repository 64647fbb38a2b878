"""Rules that label posts, answers and errors.  Plain columns, no UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c, let, strip

# Wording that alone marks an advertisement, first match wins.
STRONG_AD = [
    r"#\s*реклам",
    r"\bреклама\b",
    r"\bна правах рекламы\b",
    r"\berid\b",
    r"\bинн\s*:?\s*\d{10}",
    r"\bпромокод",
    r"\bpromo\s*code\b",
    r"#\s*ad\b",
    r"#\s*sponsored\b",
    r"\bsponsored\b",
    r"\bпартн[её]рск\w* (пост|материал|публикац)",
    r"\bказино\b",
    r"\bбукмекер",
    r"\bcasino\b",
]

# Wording that counts one point each.
WEAK_AD = [
    r"\bрозыгрыш",
    r"\bgiveaway\b",
    r"\bскидк\w*\s+(до\s+)?\d+\s*%",
    r"\b\d+\s*%\s*скидк",
    r"\bкурс\w*\b",
    r"\bвебинар",
    r"\bзаработ\w*",
    r"\bпассивн\w+ доход",
    r"\bинвест\w*",
    r"\bкрипт\w*",
    r"\bставк[иау]\b",
    r"\bбесплатно\b",
    r"\bжми\b",
    r"\bпереходи(те)?\b",
    r"\bуспей\w*\b",
    r"\bзаказ\w*\b",
    r"\bкупи(ть|те)?\b",
    r"\bbuy now\b",
    r"\bdiscount\b",
    r"\blimited offer\b",
]

# Link shapes.
INVITE = r"(t\.me|telegram\.me)/(\+|joinchat/)"
BOT_START = r"(t\.me|telegram\.me)/\w+\?start="
FEED_LINK = r"(?:https?://)?(?:t\.me|telegram\.me)/(?:s/)?([A-Za-z]\w{3,31})"
MENTION = r"(?<![\w/])@([A-Za-z]\w{3,31})"
URL = r"https?://\S+|(?:t\.me|telegram\.me)/\S+"

# Words found in error texts, tested in this order of classes.
LIMIT_MARKERS = [
    "usage limit", "usagelimit", "rate limit", "ratelimit", "rate_limit", "too many requests",
    "429", "quota", "limit reached", "try again at", "usage_limit",
]
AUTH_MARKERS = [
    "401", "unauthorized", "not logged in", "log in", "login required", "refresh token",
    "token expired", "invalid_grant", "authentication", "requiresopenaiauth", "sign in",
]
TRANSIENT_MARKERS = [
    "resource temporarily unavailable", "errno 11", "cannot allocate memory", "can't start new thread",
    "broken pipe", "timed out", "timeout", "connection", "network", "temporarily", "overloaded",
    "server error", "502", "503", "504", "stream disconnected", "unexpected eof", "reset by peer",
]
TRANSIENT_PATTERN = (
    "errno 11|resource temporarily unavailable|cannot allocate memory|can't start new thread|broken pipe|"
    "timed out|timeout|connection|network|temporar|overloaded|server error|50[234]|stream disconnected|"
    "unexpected eof|reset by peer"
)

FLAGS = "(?iuU)"

# For each wording, in the order above, a text without which it cannot match.
STRONG_NEEDS = [
    "реклам", "реклама", "на правах", "erid", "инн", "промокод", "promo", "#", "#", "sponsored", "парт", "казино",
    "букмекер", "casino",
]
WEAK_NEEDS = [
    "розыгрыш", "giveaway", "скидк", "скидк", "курс", "вебинар", "заработ", "пассивн", "инвест", "крипт", "ставк",
    "бесплатно", "жми", "переходи", "успей", "заказ", "куп", "buy now", "discount", "limited offer",
]
# Lower-case characters that match another one when case is ignored.
ODD_CASE = "[ſıᲀ-ᲈ]"


def _hit(low: Column, odd: Column, pattern: str, need: str) -> Column:
    """``low`` matches ``pattern``; the pattern is only tried where the text it needs occurs."""
    return (low.contains(need) | odd) & low.rlike(FLAGS + pattern)


def strong_ad(text: str | Column, extra_words: list[str] | None = None) -> Column:
    """Reason with the words of the first strong pattern that matches, else ''."""
    extra = [w.strip().lower() for w in extra_words or [] if w.strip()]
    known = [*zip(STRONG_AD, STRONG_NEEDS, strict=True), *((re.escape(w), "") for w in extra)]

    def first(low: Column) -> Column:
        def found(odd: Column) -> Column:
            hits = [
                F.when(_hit(low, odd, p, need), F.concat(F.lit("advertisement: "), strip(F.regexp_extract(low, FLAGS + p, 0))))
                for p, need in known
            ]
            return F.coalesce(*hits, F.lit(""))

        return let(low.rlike(ODD_CASE), found)

    return let(F.lower(c(text)), first)


def all_links(text: str | Column, links: str | Column) -> Column:
    none = F.array().cast("array<string>")
    found = F.when(~c(text).contains("/"), none).otherwise(F.regexp_extract_all(c(text), F.lit(FLAGS + f"({URL})"), F.lit(1)))
    return F.array_distinct(
        F.transform(F.concat(c(links), found), lambda u: F.lower(F.rtrim(u, F.lit("/.,)"))))
    )


def promo_score(text: str | Column, links: str | Column, buttons: str | Column, feed: str | Column) -> Column:
    """Points for promo wording, invites, foreign feeds, buttons and many links."""
    none = F.array().cast("array<string>")
    at = F.when(~c(text).contains("@"), none).otherwise(F.regexp_extract_all(c(text), F.lit("(?U)" + MENTION), F.lit(1)))
    mentioned = F.transform(at, F.lower)

    def of_links(urls: Column) -> Column:
        linked = F.transform(urls, lambda u: F.lower(F.regexp_extract(u, FLAGS + FEED_LINK, 1)))
        foreign = F.array_except(F.array_union(linked, mentioned), F.array(F.lit(""), F.lower(c(feed))))
        invites = F.size(F.filter(urls, lambda u: u.rlike(FLAGS + INVITE) | u.rlike(FLAGS + BOT_START)))
        return 2 * invites + F.size(foreign) + (F.size(urls) >= 3).cast("int")

    def wording(low: Column) -> Column:
        weak = [*zip(WEAK_AD, WEAK_NEEDS, strict=True)]
        return let(low.rlike(ODD_CASE), lambda odd: sum((_hit(low, odd, p, need).cast("int") for p, need in weak), F.lit(0)))

    return let(F.lower(c(text)), wording) + let(all_links(text, links), of_links) + (c(buttons) > 0).cast("int")


def long_text(text: str | Column, max_chars: int = 700) -> Column:
    """True when the text without links is longer than the limit (0 = off)."""
    if not max_chars:
        return F.lit(False)
    bare = F.when(~c(text).contains("/"), c(text)).otherwise(F.regexp_replace(c(text), FLAGS + URL, ""))
    return F.char_length(strip(bare)) > max_chars


def post_verdict(
    text: str | Column,
    links: str | Column,
    buttons: str | Column,
    feed: str | Column,
    has_media: str | Column | None = None,
    max_chars: int = 700,
    extra_words: list[str] | None = None,
) -> Column:
    """Why a post is refused, '' when it passes.  Posts without media pass."""
    verdict = F.coalesce(
        F.nullif(strong_ad(text, extra_words), F.lit("")),
        F.when(promo_score(text, links, buttons, feed) >= 3, F.lit("advertisement (links and promo wording)")),
        F.when(long_text(text, max_chars), F.lit("not a meme (long text post)")),
        F.lit(""),
    )
    return verdict if has_media is None else F.when(c(has_media), verdict).otherwise("")


def analysis_verdict(is_ad: str | Column, is_meme: str | Column) -> Column:
    """E5: verdict of the describing model; an unknown flag is no verdict."""
    return (
        F.when(F.coalesce(c(is_ad), F.lit(False)), "advertisement (analysis)")
        .when(~F.coalesce(c(is_meme), F.lit(True)), "not a meme (analysis)")
        .otherwise("")
    )


def _any_of(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def classify_error(message: str | Column) -> Column:
    """Limit, auth, transient or other."""
    low = F.lower(c(message))
    return (
        F.when(_any_of(low, LIMIT_MARKERS), "limit")
        .when(_any_of(low, AUTH_MARKERS), "auth")
        .when(_any_of(low, TRANSIENT_MARKERS), "transient")
        .otherwise("other")
    )


def transient_error(message: str | Column) -> Column:
    """True when a retry may help."""
    return c(message).rlike("(?i)" + TRANSIENT_PATTERN)
