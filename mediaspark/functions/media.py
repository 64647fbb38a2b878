"""File heads, content paths and 256-bit perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c, let

HASH_BITS = 256
MIN_ONES = 24

# Brands of the ISO media container that hold still pictures.
HEIC_BRANDS = ("heic", "heix", "hevc", "heim", "heis", "mif1", "msf1")
AVIF_BRANDS = ("avif", "avis")


def sniff_type(content: str | Column) -> Column:
    """A3: ``kind, mime, ext`` from the first 512 bytes; NULL when unsupported."""
    head = F.decode(F.substring(c(content), 1, 512), "ISO-8859-1")
    brand = F.substring(head, 9, 4)

    def media(kind: str, mime: str, ext: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(mime).alias("mime"), F.lit(ext).alias("ext"))

    iso = (
        F.when(brand == "qt  ", media("video", "video/quicktime", "mov"))
        .when(brand.isin(*HEIC_BRANDS), media("image", "image/heic", "heic"))
        .when(brand.isin(*AVIF_BRANDS), media("image", "image/avif", "avif"))
        .otherwise(media("video", "video/mp4", "mp4"))
    )
    ebml = F.when(head.contains("webm"), media("video", "video/webm", "webm")).otherwise(
        media("video", "video/x-matroska", "mkv")
    )
    return (
        F.when((F.length(c(content)) >= 12) & (F.substring(head, 5, 4) == "ftyp"), iso)
        .when(head.startswith("\x1a\x45\xdf\xa3"), ebml)
        .when(head.startswith("\xff\xd8\xff"), media("image", "image/jpeg", "jpg"))
        .when(head.startswith("\x89PNG\r\n\x1a\n"), media("image", "image/png", "png"))
        .when(head.startswith("GIF87a") | head.startswith("GIF89a"), media("gif", "image/gif", "gif"))
        .when(head.startswith("RIFF") & (brand == "WEBP"), media("image", "image/webp", "webp"))
        .when(head.startswith("RIFF") & (brand == "AVI "), media("video", "video/x-msvideo", "avi"))
        .when(head.startswith("BM"), media("image", "image/bmp", "bmp"))
    )


def original_path(sha: str | Column, ext: str | Column) -> Column:
    """Where the bytes of a file live."""
    s = c(sha)
    return F.concat_ws("/", F.lit("originals"), F.substring(s, 1, 2), F.substring(s, 3, 2), F.concat_ws(".", s, c(ext)))


def thumb_path(sha: str | Column) -> Column:
    """Where the preview picture lives."""
    s = c(sha)
    return F.concat_ws("/", F.lit("thumbs"), F.substring(s, 1, 2), F.substring(s, 3, 2), F.concat(s, F.lit(".webp")))


def gradient_hash(grid: str | Column, rows: int = 16, cols: int = 17) -> Column:
    """bit = a cell is larger than its right neighbour; four 64-bit words."""
    wide = cols - 1
    per_word = rows * wide // 4

    def flat(steps: Column) -> Column:
        # the last cell of a row has no right neighbour
        padded = F.concat(steps, F.array_repeat(F.lit(None).cast("bigint"), rows * cols))
        return F.flatten(F.array(*(F.slice(padded, r * cols + 1, wide) for r in range(rows))))

    def word(bits: Column, w: int) -> Column:
        mine = F.slice(bits, w * per_word + 1, per_word)
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit))

    def words(g: Column) -> Column:
        steps = F.zip_with(g, F.slice(g, 2, rows * cols), lambda x, y: (x > y).cast("bigint"))
        return let(steps, lambda s: let(flat(s), lambda bits: F.array(*(word(bits, w) for w in range(4)))))

    return let(c(grid), words)


def hash_from_text(bits: str | Column) -> Column:
    """Four 64-bit words from 256 characters '0'/'1'; NULL for another length."""
    b = c(bits)

    def half(start: int) -> Column:
        return F.conv(F.substring(b, start, 32), 2, 10).cast("bigint")

    words = [F.shiftleft(half(1 + 64 * w), 32).bitwiseOR(half(33 + 64 * w)) for w in range(4)]
    return F.when(F.length(b) == HASH_BITS, F.array(*words))


def hash_text(words: str | Column) -> Column:
    """The 256-character form of a hash."""
    return F.array_join(F.transform(c(words), lambda w: F.lpad(F.bin(w), 64, "0")), "")


def ones(words: str | Column) -> Column:
    w = c(words)
    return sum((F.bit_count(w[i]).cast("int") for i in range(1, 4)), F.bit_count(w[0]).cast("int"))


def usable_hash(words: str | Column) -> Column:
    """Neither nearly blank nor nearly full."""
    return F.coalesce(ones(words).between(MIN_ONES, HASH_BITS - MIN_ONES), F.lit(False))


def hamming(a: str | Column, b: str | Column) -> Column:
    """Count of different bits."""
    x, y = c(a), c(b)
    return sum(
        (F.bit_count(x[i].bitwiseXOR(y[i])).cast("int") for i in range(1, 4)),
        F.bit_count(x[0].bitwiseXOR(y[0])).cast("int"),
    )
