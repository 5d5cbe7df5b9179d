"""Small awkward tables and plain versions to hold operators against."""

import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")

BASE = " ".join(f"w{i}" for i in range(60))
NEAR = BASE.replace("w30", "x30")
FAR = " ".join(f"v{i}" for i in range(60))
AWKWARD = [
    (1, BASE, "en", "a", 10), (2, BASE, "en", "a", 10), (2, BASE, "en", "a", 10), (3, NEAR, None, "a", None), (4, FAR, "de", None, 5),
    (None, FAR + " tail", "de", "b", 5), (5, None, "de", "b", 0), (6, "", "fr", "b", 0), (7, " \n\t ", "fr", "b", 4), (8, "one two", "fr", "c", 7),
    (9, "ONE two", "fr", "c", 7), (10, "é ü ß 　x y", "xx", "c", 3), (11, "long " * 30_000 + "end", "en", "a", 1), (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, extra=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, SCHEMA)
    if extra:  # names that operators use inside
        for c in ("rk", "fp", "score", "removed", "copy", "weight", "_key", "component_id"):
            df = df.withColumn(c, F.lit("own"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(b):
    return bytes(x + 32 if 65 <= x <= 90 else x for x in b)


def words(text):
    return WORD.findall(lower((text or "").encode()))


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(sets, num, den):
    """Smallest reachable index of each set, by all pairs."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]
