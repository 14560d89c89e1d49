"""Documents that the tests share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns under names that operators could use themselves, with a row's values.
CLASHING = ("__id", "__key", "__clean", "__s", "__copies", "node", "bucket", "size", "keep", "n", "g", "fit", "TEXT", "text_key", "bin", "rank", "count", "__copy", "root")
WORDS = "the of and river mountain signal paper winter garden number through between market season engine letter bridge common winter glass paint silver method".split()


def prose(r: random.Random, n: int) -> str:
    out = []
    while len(out) < n:
        k = r.randint(6, 14)
        s = [r.choice(WORDS) + r.choice(["", "", "s", "ed", "ing", "er"]) for _ in range(k)]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:n])


def odd(spark):
    """Nulls in any column, empty, blank, wordless, short and very long texts, ties and repeated rows."""
    r = random.Random(3)
    same = prose(r, 120)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "", None, None, 0), (4, " \n\t", "en", "a", 3), (5, "!!! ???", "en", "b", 7), (6, "one", "en", "b", 3), (7, "one two", "en", None, 7),
        (8, same, "en", "a", len(same)), (9, same, "en", "a", len(same)), (9, same, "en", "a", len(same)), (None, same, None, "a", None), (None, None, None, None, None), (10, prose(r, 60_000), "en", "a", 400_000),
        (11, "é" * 50_000, "fr", "b", -5), (12, prose(r, 90), "de", "c", 500), (12, prose(r, 80), "de", "c", 500), (13, "ghp_" + "a" * 30 + "1yLcDB" + " token ퟿", "en", "c", 2**40), (14, "x " * 5_000, "en", "a", 10_000),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def extra(df):
    """The table with columns of clashing names."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING) if c not in ("TEXT",)])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is None, repr(x)) for x in row)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=key)
