"""Small hostile tables for the training-data operators."""

import random

from pyspark.sql import types as T

WORDS = "alpha beta gamma delta river stone cloud bridge market winter summer garden window paper silver copper engine harbor lantern meadow".split()
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       # names that the operators use themselves
                       T.StructField("score", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("findings", T.StringType()),
                       T.StructField("node", T.StringType()), T.StructField("root", T.StringType()), T.StructField("host", T.StringType()), T.StructField("ids", T.StringType()),
                       T.StructField("length", T.StringType()), T.StructField("held_out", T.StringType()), T.StructField("block", T.StringType())])


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows():
    rng = random.Random(7)
    out = []
    add = lambda i, t, lang="en", src="src0": out.append((i, t, lang, src, None if t is None else len(t)))
    for i in range(30):
        add(i, sentence(rng, rng.randint(25, 60)).capitalize() + ".", "en" if i % 3 else "xx", f"src{i % 3}")
    base = out[5][1]
    add(40, base)  # exact copies
    add(41, base)
    add(41, base)  # a repeated row
    add(42, base + " coda")
    add(43, None)
    add(44, "")
    add(45, " \n\t ")
    add(46, "12345 --- 99")
    add(47, "one two")
    add(48, "word", None)
    add(49, sentence(rng, 40), None, None)
    add(None, sentence(rng, 30))
    add(None, None, None, None)
    add(50, "Été   straße   naïve café́ \U0001f600 don't <|endoftext|> x\x1cy\x85z")
    add(51, ("word " * 9 + "\n") * 30)
    add(52, sentence(rng, 60_000))  # very long
    add(53, "a" * 5000)
    return out


def docs(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(*r, *["x"] * 11) for r in data], SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def write_tables(spark, path, data=None, benchmark=(), pages=()):
    """The tables that a query reads, under ``path``."""
    docs(spark, data).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)
