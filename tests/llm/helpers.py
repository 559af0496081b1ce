"""Small tables with every awkward case, and plain Python versions of what operators compute."""

import random
import re

SF = "/root/testdata/sf0.001"
#: Extra columns whose names operators use themselves.
SCHEMA = "doc_id long, text string, lang string, fingerprint string, score string, rank int, hash string, units int, id long"


def awkward(spark):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [
        (None, None), (None, "null key"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"),
        (5, "é ß 漢字 emoji 😀 <|endoftext|> end"), (6, "a b c d e f g h i j k l\nA B C D E F G H I J K L"), (7, long), (8, long),
        (9, "1234 5678 !!! ???"),
    ]
    return spark.createDataFrame([(k, t, "en", "x", "y", 1, "z", 2, 3) for k, t in texts], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def prose(rng: random.Random, n: int, stock: int = 400) -> str:
    return " ".join(f"{'bcdfghklmn'[i % 10]}{'aeiou'[i % 5]}{i}x" for i in (rng.randrange(stock) for _ in range(n)))
