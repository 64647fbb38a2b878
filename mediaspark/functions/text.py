"""Text columns: search text, list cleaning, parsing of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A column named inside a lambda would be computed again for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(col: str | Column) -> Column:
    """Trim white space as Unicode defines it."""
    return F.regexp_replace(c(col), f"^{WS}+|{WS}+$", "")


def collapse(col: str | Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.btrim(F.regexp_replace(c(col), f"{WS}+", " "))


def valid_utf8(col: str | Column) -> Column:
    """Drop bytes that are not UTF-8; a genuine U+FFFD stays."""
    return F.when(F.is_valid_utf8(c(col)), c(col)).otherwise(
        F.regexp_replace(F.make_valid_utf8(c(col)), "�", "")
    )


def normalize_query(col: str | Column) -> Column:
    """B1: trim, cut to 200 characters, valid UTF-8, lower case, single blanks."""
    return let(F.substring(strip(col), 1, 200), lambda s: collapse(F.lower(valid_utf8(s))))


def blank_if_null(col: str | Column) -> Column:
    return F.coalesce(c(col), F.lit(""))


def joined(col: str, sep: str) -> Column:
    return F.array_join(F.col(col), sep)


def head_text() -> Column:
    """The strong fields, joined by blanks."""
    return F.concat_ws(" ", "title", "template", "song", joined("tags", " "), joined("people", " "))


def search_text() -> Column:
    """B2: every searchable field on its own line; empty fields keep their line."""
    return F.concat_ws(
        "\n",
        "title",
        "ocr_text",
        "description",
        "transcript",
        "song",
        joined("sounds", " "),
        "template",
        joined("tags", " "),
        joined("objects", " "),
        joined("people", " "),
        "caption",
    )


def embedding_text() -> Column:
    """The non-empty fields that describe an item, one per line."""
    parts = [
        F.col("title"),
        F.col("ocr_text"),
        F.col("description"),
        F.col("template"),
        joined("people", ", "),
        joined("objects", ", "),
        joined("tags", ", "),
        F.substring("transcript", 1, 1000),
        F.col("song"),
        joined("sounds", ", "),
    ]
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n")


def clean_list(col: str | Column, limit: int, lower: bool = False) -> Column:
    """Tidy a list of labels; the first spelling of a label wins."""
    tidy = F.transform(c(col), lambda x: F.btrim(collapse(x), F.lit(" #,.;")))
    if lower:
        tidy = F.transform(tidy, F.lower)
    tidy = F.filter(tidy, lambda x: x.isNotNull() & (x != "") & (F.char_length(x) <= 120))
    return F.slice(F.coalesce(distinct_by_case(tidy), F.array().cast("array<string>")), 1, limit)


def clean_list_plain(col: str | Column) -> Column:
    """B6, the form used for human edits: trim and drop repeats only."""
    tidy = F.filter(F.transform(c(col), strip), lambda x: x.isNotNull() & (x != ""))
    return distinct_by_case(tidy)


def distinct_by_case(arr: Column) -> Column:
    """Order-preserving distinct that ignores letter case."""
    return let(
        arr,
        lambda v: let(
            F.transform(v, F.lower),
            lambda keys: F.filter(v, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1),
        ),
    )


def answer_json(raw: str | Column) -> Column:
    """The JSON object inside a model answer, as a variant; NULL if there is none."""
    text = strip(raw)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    body = F.when(fenced != "", fenced).when(text.startswith("{"), text).otherwise(braces)
    parsed = F.try_parse_json(F.nullif(body, F.lit("")))
    return let(parsed, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def parse_analysis(raw: str | Column) -> Column:
    """Typed fields of an analysis answer, or ``error`` when it is not JSON."""
    return let(answer_json(raw), _analysis_fields)


def _analysis_fields(v: Column) -> Column:
    def text(key: str, size: int) -> Column:
        return F.substring(strip(blank_if_null(F.try_variant_get(v, f"$.{key}", "string"))), 1, size)

    def labels(key: str, size: int, lower: bool = False) -> Column:
        # only strings are labels, whatever else the list holds
        values = F.try_variant_get(v, f"$.{key}", "array<variant>")
        strings = F.filter(values, lambda x: F.schema_of_variant(x) == "STRING")
        return clean_list(F.transform(strings, lambda x: F.try_variant_get(x, "$", "string")), size, lower)

    def flag(key: str, default: bool) -> Column:
        """An absent flag has the default; a present value counts as in JSON truth: null, zero and empty are false."""
        value = F.try_variant_get(v, f"$.{key}", "variant")
        kind = F.schema_of_variant(value)
        shown = F.try_variant_get(v, f"$.{key}", "string")
        number = F.try_variant_get(v, f"$.{key}", "double")
        truth = (
            F.when(kind == "VOID", False)
            .when(kind == "BOOLEAN", F.try_variant_get(v, f"$.{key}", "boolean"))
            .when(kind == "STRING", shown != "")
            .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~shown.isin("[]", "{}"))
            .otherwise(number != 0)
        )
        return F.when(value.isNull(), default).otherwise(F.coalesce(truth, F.lit(True)))

    lang = F.substring(F.lower(strip(blank_if_null(F.try_variant_get(v, "$.language", "string")))), 1, 8)
    return F.struct(
        F.when(v.isNull(), F.lit("model response is not a JSON object")).otherwise("").alias("error"),
        text("title", 300).alias("title"),
        text("text", 8000).alias("ocr_text"),
        text("description", 4000).alias("description"),
        labels("objects", 40).alias("objects"),
        labels("people", 20).alias("people"),
        text("template", 200).alias("template"),
        labels("tags", 40, True).alias("tags"),
        text("mood", 60).alias("mood"),
        F.when(lang == "none", "").otherwise(lang).alias("lang"),
        flag("nsfw", False).alias("nsfw"),
        flag("is_meme", True).alias("is_meme"),
        flag("is_ad", False).alias("is_ad"),
    )


def parse_compare(raw: str | Column) -> Column:
    """Verdict of a pair comparison; confidence is clamped to 0..1."""
    return let(answer_json(raw), _compare_fields)


def _compare_fields(v: Column) -> Column:
    same = F.try_variant_get(v, "$.same", "boolean")
    strict = F.schema_of_variant(F.try_variant_get(v, "$.same", "variant")) == "BOOLEAN"
    confidence = F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(0.0))
    return F.struct(
        F.when(v.isNull(), F.lit("model response is not a JSON object")).otherwise("").alias("error"),
        F.coalesce(same & strict, F.lit(False)).alias("same"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
        F.substring(strip(blank_if_null(F.try_variant_get(v, "$.reason", "string"))), 1, 500).alias("reason"),
        F.when(F.try_variant_get(v, "$.better", "double") == 2, 2).otherwise(1).alias("better"),
    )


def audio_window_starts(samples: str | Column, rate: int = 16000, seconds: int = 10, limit: int = 12) -> Column:
    """First sample of each listening window; long clips keep ``limit`` even picks."""
    n = c(samples).cast("bigint")
    size = rate * seconds
    last = n - size // 2 - 1
    starts = F.sequence(F.lit(0).cast("bigint"), last, F.lit(size).cast("bigint"))
    picked = let(
        starts,
        lambda s: F.transform(
            F.sequence(F.lit(0), F.lit(limit - 1)),
            lambda i: F.get(s, F.floor(i * (F.size(s).cast("double") / limit)).cast("int")),
        ),
    )
    one = F.array(F.lit(0).cast("bigint"))
    none = F.array().cast("array<bigint>")
    return (
        F.when(n < rate // 2, none)
        .when(n <= size, one)
        .when(F.size(starts) > limit, picked)
        .otherwise(starts)
    )


def one_decimal(x: Column) -> Column:
    """One decimal place, rounded from the exact binary value."""
    return F.replace(F.format_number(x.cast("double"), 1), F.lit(","), F.lit(""))


CAMERA_NAME = r"^[\w\-. ]*\d{4,}[\w\-. ]*$"


def prompt_text(instructions: str) -> Column:
    """The request text for a describing model, from item columns.

    Reads ``kind, frame_count, frame_times, duration_ms, transcript, caption,
    original_name, extra, sounds, song``.  Empty inputs leave no paragraph.
    """
    seconds = one_decimal(F.col("duration_ms") / 1000.0)
    times = F.array_join(F.transform("frame_times", lambda t: F.concat(one_decimal(t), F.lit("s"))), ", ")
    what = F.when(F.col("kind") == "gif", "animated GIF").otherwise("video")
    opening = F.when(F.col("kind") == "image", "The item is the attached image.").otherwise(
        F.concat(
            F.lit("The item is an "), what, F.lit(" of "), seconds, F.lit(" s. The "),
            F.col("frame_count").cast("string"), F.lit(" attached images are its frames in time order"),
            F.when(times != "", F.concat(F.lit(" (at "), times, F.lit(")"))).otherwise(""),
            F.lit(". Describe the whole clip."),
        )
    )

    def block(label: str, col: Column) -> Column:
        return F.when(col != "", F.concat(F.lit(label + "\n<<<\n"), col, F.lit("\n>>>")))

    heard = F.array_join(F.slice("sounds", 1, 10), "; ")
    return F.concat_ws(
        "\n\n",
        opening,
        block("Speech transcript (machine made):", F.substring("transcript", 1, 4000)),
        F.when(heard != "", F.concat(F.lit("Sounds heard, strongest first: "), heard)),
        F.when(F.col("song") != "", F.concat(F.lit("Song heard: "), F.substring("song", 1, 200))),
        F.when((heard != "") | (F.col("song") != ""), F.lit("Describe what is heard as well.")),
        block("Caption given by the uploader:", F.substring("caption", 1, 1500)),
        F.when(
            (F.col("original_name") != "") & ~F.col("original_name").rlike("(?U)" + CAMERA_NAME),
            F.concat(F.lit("File name: "), F.substring("original_name", 1, 200)),
        ),
        F.lit(instructions),
        F.when(strip("extra") != "", F.concat(F.lit("Extra instructions:\n"), strip("extra"))),
    )


def clean_name(col: str | Column) -> Column:
    """Base name of a path, at most 255 bytes, never a split character."""
    path = F.regexp_replace(F.replace(c(col), F.lit("\\"), F.lit("/")), r"/+$", "")
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    base = F.when(base.isin(".", "/"), "").otherwise(base)
    sizes = F.transform(F.split(base, ""), F.octet_length)
    # longest prefix that fits: count the running byte totals within the limit
    room = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("bytes")),
        lambda acc, s: F.struct(
            (acc["n"] + F.when(acc["bytes"] + s <= 255, 1).otherwise(0)).alias("n"),
            (acc["bytes"] + s).alias("bytes"),
        ),
        lambda acc: acc["n"],
    )
    return valid_utf8(F.when(F.octet_length(base) <= 255, base).otherwise(F.substr(base, F.lit(1), room)))


# The shape of a public feed name, link hosts and reserved paths.
FEED_NAME = r"^[A-Za-z][A-Za-z0-9_]{3,31}$"
FEED_HOSTS = r"(?i)^(www\.t\.me/|t\.me/|telegram\.me/|telegram\.dog/)"
FEED_RESERVED = ("joinchat", "addstickers", "addemoji", "share", "proxy", "socks", "login")


def normalize_feed_name(col: str | Column) -> Column:
    """Feed name from ``@name`` or a link, lower case; NULL when invalid."""
    s = F.regexp_replace(strip(col), "^@", "")
    s = F.regexp_replace(s, "^https://", "")
    s = F.regexp_replace(s, "^http://", "")
    s = F.regexp_replace(s, FEED_HOSTS, "")
    s = F.regexp_replace(s, "^s/", "")
    s = F.lower(F.regexp_replace(s, r"(?s)[/?#].*$", ""))
    return F.when(s.rlike("(?i)" + FEED_NAME) & ~s.isin(*FEED_RESERVED), s)


def tokens(col: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(c(col)), r"[^\p{L}\p{N}]+"), "")


# Section headings of the older answer format.
SECTION_DESCRIPTION = r"(?s)(?:VISUAL DESCRIPTION|1\.\s*VISUAL DESCRIPTION):(.*?)(?:(?:TEXT EXTRACTION|2\.)|$)"
SECTION_TEXT = (
    r"(?s)(?:TEXT EXTRACTION|2\.\s*TEXT EXTRACTION):(.*?)(?:(?:VISUAL CHARACTERISTICS|CONTENT CONTEXT|3\.)|$)"
)
SECTION_TAGS = r"(?s)(?:SEARCH TAGS|TAGS|SEARCH OPTIMIZATION|6\.\s*SEARCH):(.*)$"


def parse_sections(raw: str | Column) -> Column:
    """L2: description, text and tags from a free-text answer with headings."""
    text = c(raw)
    description = F.regexp_extract(text, SECTION_DESCRIPTION, 1)
    ocr = F.regexp_extract(text, SECTION_TEXT, 1)
    listed = F.from_json(F.nullif(F.regexp_extract(text, r"(\[.*?\])", 1), F.lit("")), "array<string>")
    section = strip(F.regexp_extract(text, SECTION_TAGS, 1))

    def tidy(arr: Column) -> Column:
        return F.transform(arr, lambda x: F.btrim(strip(x), F.lit("\"'")))

    bullets = F.regexp_extract_all(section, F.lit(r"[-*•]\s*([^-*•\n]+)"), F.lit(1))
    commas = F.filter(F.split(section, r",|\n"), lambda x: strip(x) != "")
    tags = (
        F.when(F.size(listed) > 0, listed)
        .when(F.size(bullets) > 0, tidy(bullets))
        .otherwise(tidy(commas))
    )
    return F.struct(
        strip(description).alias("description"),
        strip(ocr).alias("ocr_text"),
        tags.alias("tags"),
    )


# Light suffix rules in the manner of the published S-stemmer and light stemmers;
# both search configurations can be repeated by any SQL engine.
ENGLISH_SUFFIX = r"(ingly|edly|ings|ing|ies|ed|es|ly|s)$"
RUSSIAN_SUFFIX = (
    r"(иями|ями|ами|иях|ого|его|ому|ему|ыми|ими|ах|ях|ов|ев|ей|ой|ый|ий|ая|яя|ое|ее|ые|ие|ых|их|ую|юю|ом|ем|ам|ям|ть|а|я|о|е|ы|и|у|ю|ь)$"
)


def stem(token: Column, config: str) -> Column:
    """Stem of a token under ``simple``, ``english`` or ``russian``."""
    if config == "simple":
        return token
    suffix = ENGLISH_SUFFIX if config == "english" else RUSSIAN_SUFFIX
    cut = F.regexp_replace(token, suffix, "")
    return F.when(F.char_length(cut) >= 3, cut).otherwise(token)
