import random

DOCS = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
_SYLLABLES = "ka lo mi ne tu ra si po ve du ha ge ri no ta be".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(2, 5))) for _ in range(n))


def documents(spark, pairs, lang="en", source="src0"):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in pairs], SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def EDGE_DOCS(spark):
    """Null id, null, empty, blank and wordless texts, one very long, ties, repeated rows, clashing extra columns."""
    long = prose(random.Random(1), 30_000)
    same = prose(random.Random(2), 120)
    pairs = [(1, None), (2, ""), (3, same), (4, same), (5, long), (6, " \n\t "), (7, "?!"), (8, same.upper()), (3, same), (None, prose(random.Random(3), 60))]
    df = documents(spark, pairs)
    cols = ["id", "xk", "label", "key", "node", "f0", "n", "words", "_id", "_source", "_block", "_host", "copy", "new", "hash"]
    return df.selectExpr("*", *[f"'x' as {c}" for c in cols])
