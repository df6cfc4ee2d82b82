"""Plain versions of what the operators do, and awkward documents."""

import itertools

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LONG = " ".join(f"w{i * 7919 % 100_003}" for i in range(30_000))


def awkward():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    base = "the cat sat on the mat and looked at the moon for a very long time indeed"
    return [
        (1, base, "en", "a", 1), (2, base, "en", "b", 1), (2, base, "en", "b", 1), (3, None, "en", "a", None), (4, "", None, "a", 0), (None, base, None, None, 5), (None, None, None, None, None),
        (5, LONG, "en", "a", 9), (6, LONG + " tail", "en", "c", 9), (7, "   \n\t ", "fr", None, 3), (8, "12 34 !!", "fr", "b", 8), (9, "é ß 日本 𝒳", "fr", "b", 8), (10, base + " x", "en", "a", 1),
    ]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def shingles(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_links(texts, threshold=0.8):
    """{id: text} of different texts -> pairs with similarity >= threshold."""
    sets = {k: shingles(t) for k, t in texts.items() if shingles(t)}
    out = []
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold - 1e-12:
            out.append((a, b))
    return out
