"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, key string, norm string, "
          "id long, target double, _row string, node long, start long, tie int, words long, spans string, score double")

LONG = " ".join(f"word{i % 977} and{i}" for i in range(9000))


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["the", "of", "alpha", "beta", "gamma.", "delta\n", "Ünï", "日本", "x@y.org", "1.2.3.4", "a|b", "tail!"]
    texts = [None, "", " ", "\n\t ", "one", "two words", "two  words", "two\twords ", LONG, LONG + " more", "é" * 700, "a" * 3000,
             "The same passage of some ten words stands here again. " * 4]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(25)]
    texts += [t + " end" for t in texts[-10:]]
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "", None]), None if t is None else len(t)))
    out += [out[4], out[4], out[8], out[20]]                      # repeated rows
    out += [(5, "another text under a used id", "en", "s1", 1)]   # tie of ids
    out += [(None, "no id at all", "en", "s2", 2), (None, None, None, None, None), (-7, out[20][1], "fr", "s9", 0)]
    return [r + (11, "k", "n", 5, 2.5, "r", 3, 4, 6, 7, "s", 0.5) for r in out]


def documents(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def records(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
