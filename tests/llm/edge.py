"""Documents that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, kind string, word string"


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ti", "É", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edge_rows():
    rng = random.Random(7)
    long = words(rng, 6000)
    texts = [None, "", " \t\n\x0b\f\r ", "one", "one two", "Sun day 　x", "a" * 5000, long, long + " x", long.replace(" ", "\n"), "tie b", "tie  b", "tieb"]
    texts += [words(rng, 60) for _ in range(20)]
    texts += ["\U0001f600 中文 é ' \" | & $ 12 34", "<|endoftext|> <s> </s>", "x" * 40 + " " + "0" * 40]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[7], rows[3], (None, "one"), (None, None), (500, texts[15]), (-3, texts[15])]
    return [(i, t, None if i == 3 else "en", "s" if i != 4 else None, None if t is None else len(t), "k", "q", "w") for i, t in rows]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
