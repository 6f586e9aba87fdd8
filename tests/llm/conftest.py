import pytest
from pyspark.sql import Row
from pyspark.sql.types import LongType, StringType, StructField, StructType

SF = "/root/testdata/sf0.001"

DOCS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        # Names that the operators' own columns have.
        StructField("score", StringType()),
        StructField("n_words", StringType()),
        StructField("shard", StringType()),
        StructField("_key", StringType()),
    ]
)

PASSAGE = " ".join(f"word{i}x{i * i % 97}" for i in range(80))
LONG = " ".join(f"w{i % 911} Ünï{i % 37}-{i}" for i in range(9_000))

TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog, again and again, near the river bank today.", "en"),
    (1, "the quick brown fox jumps over the lazy dog, again and again, near the river bank today.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "12345 67890 !!! ...", "fr"),
    (5, "Le chat est sur la table et le chien dort dans la maison près de la rivière.", "fr"),
    (6, LONG, "en"),
    (7, LONG + " tail", "en"),
    (8, f"start {PASSAGE} end", "en"),
    (9, f"before it {PASSAGE} after it, quite different", None),
    (10, "a", "en"),
    (11, "a", "en"),
    (11, "a", "en"),
    (12, "ab <|endoftext|> cd\n\n  x\x1cy ½ Ⅷ 中文 ​😀 don't we'll", "en"),
    (None, "no id at all but some words to speak of", "en"),
    (None, None, None),
    (13, "x" * 3_000, "en"),
    (14, "Der Hund und die Katze sind in dem Haus und der Garten ist groß und schön.", "de"),
]


@pytest.fixture(scope="session")
def messy_rows():
    return [(i, t, lang, "src", 0 if t is None else len(t), "s", "n", "h", "k") for i, t, lang in TEXTS]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def folder():
    return SF


def plain(frame) -> list[dict]:
    return [r.asDict(recursive=True) if isinstance(r, Row) else r for r in frame.collect()]


def texts_of(frame) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def joins_of(frame) -> list[str]:
    """The joins of the optimized plan, the last one first."""
    return [x for x in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]


def record_staged(monkeypatch, module) -> list[tuple]:
    """What the module stages from now on: name, the frame that is written, the table that it becomes."""
    seen, staged = [], module.staged

    def spy(df, name):
        seen.append((name, df, staged(df, name)))
        return seen[-1][2]

    monkeypatch.setattr(module, "staged", spy)
    return seen
