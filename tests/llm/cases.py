"""Edge rows shared by the tests of the training-data operators."""

from pyspark.sql import functions as F

LONG = "Word after word, " * 40_000
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog.\nReleased under the MIT License."),
    (2, "The quick brown fox jumps over the lazy dog.\nReleased under the MIT License."),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, "no id here, none at all"),
    (None, None),
    (7, LONG),
    (8, "<|endoftext|> a  b   c   \x1c é é 世界 \U0001f600 ΣΑΣ it's 12½"),
    (8, "<|endoftext|> a  b   c   \x1c é é 世界 \U0001f600 ΣΑΣ it's 12½"),
    (9, "a a a a a a a a a a"),
    (10, "### $$$ %%% *** &&& | | < >" * 30),
    (-3, "You idiot! YOU are st0pid, id!ot, sooo dumb."),
]
# Names that operators use for columns of their own.
CLASHES = (
    "score predicted held_out n_words kept base_failed length piece start ids_crc32 sequence_id offset fp text_hash root component_id "
    "_row _counts row unit line n b h part shard label y count ids at vec"
).split()


def docs_frame(spark, rows=DOCS):
    """Documents with all the columns of the table, and with clashing ones besides."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for name in CLASHES:
        df = df.withColumn(name, F.lit("x"))
    return df


def labels_frame(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, score string")


def values(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
