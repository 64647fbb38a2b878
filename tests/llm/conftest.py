import os

import pytest
from pyspark.sql import types as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        *(T.StructField(c, T.StringType()) for c in ("_row", "_class", "_gone", "_key", "_times", "_block", "size", "s", "index", "length", "start")),
    ]
)

BASE = "river stone meadow lantern copper violet harbor winter saddle orchard thunder pocket marble feather candle ribbon".split()


def prose(seed: int, n: int) -> str:
    """Words that depend on the seed, in lines of nine."""
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 48271 + 11) % 2147483647
        out.append(BASE[x % len(BASE)] + BASE[(x // 97) % len(BASE)][: 1 + x % 4] + str(x % 41) + ("\n" if i % 9 == 8 else " "))
    return "".join(out).strip()


def rows() -> list[tuple]:
    texts: list[tuple] = [
        (5, None), (7, ""), (8, " \n\t "), (None, prose(1, 60)), (None, prose(1, 60)), (9, prose(2, 3)), (9, prose(2, 3)),
        (10, "one two three four"), (11, "one two three four"), (12, prose(3, 9000)), (13, "x" * 40_000), (14, "ñandú  über straße   ½ 漢字 \x00 end\n\n"),
    ]
    for k in range(20, 50):
        texts.append((k, prose(k, 40 + 9 * (k % 7))))
    for k in range(60, 68):  # near copies of one text, and a passage shared by unlike texts
        words = prose(20, 300).split(" ")
        words[k] = f"changed{k}"
        texts.append((k, " ".join(words)))
        texts.append((k + 20, prose(100 + k, 50) + "\n" + prose(999, 45).replace("\n", " ") + "\n" + prose(200 + k, 50)))
    texts.append((100, prose(20, 300)))
    return [(d, t, ("en", "de", None)[(d or 0) % 3], ("a", "b", None, "Zz")[(d or 0) % 4], 1, *["clash"] * 11) for d, t in texts]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "docs")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return docs.limit(0)
