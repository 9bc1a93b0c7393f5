import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    out = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    return out


#: Nulls, empty texts, a very long one, ties and repeated rows.
WORDS = "the quick brown fox jumps over a lazy dog and runs far away from it while rain falls on every old stone wall".split()


def text(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("" if x % 3 else str((x >> 4) % 50)))
    return " ".join(out)


ROWS = [
    (1, text(1, 120), "en", "a", 0), (2, text(2, 300), "de", "b", 0), (3, text(1, 120), "en", "a", 0), (4, None, None, None, None),
    (5, "", "en", "a", 0), (6, " \t\n ", "fr", "b", 3), (7, text(7, 60) + "\n" + text(1, 120), "en", None, 0), (8, text(8, 20000), "en", "c", 0),
    (9, "é☃ 漢字 Ünïcode " * 30, "fr", "a", 0), (None, text(2, 300), "en", "a", 0), (2, text(2, 300), "de", "b", 0), (10, "x", "en", "d", 1),
    (11, text(11, 80) + " " + text(8, 20000)[300:900], "en", "a", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """With columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("fp", "component_id", "score", "size", "shard", "slot", "g", "h", "range", "key", "tie", "ids", "kept", "n_words", "w", "lines", "entities")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
