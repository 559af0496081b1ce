import random
from itertools import combinations

import numpy as np
from helpers import SF, awkward, documents, empty, prose, words

from tableferry.llm import decontaminate
from tableferry.llm.queries import QUERIES


def brute(texts, items):
    """Best share of equal tokens in a window of 20 tokens on any diagonal, where it is 0.8."""
    ids, out = {}, {}
    code = lambda t: np.array([ids.setdefault(w, len(ids)) for w in words(t)], dtype=int)
    coded = {i: code(t) for i, t in items.items()}
    for d, t in texts.items():
        own = code(t)
        for i, item in coded.items():
            width = min(20, len(item))
            if not width or len(own) < width:
                continue
            equal = item[:, None] == own[None, :]
            for k in range(width - len(item), len(own) - width + 1):
                line = np.diagonal(equal, k).astype(int)
                if line.sum() >= 0.8 * width:
                    best = np.convolve(line, np.ones(width, int), "valid").max() / width
                    if best >= 0.8 - 1e-9:
                        out[d, i] = max(best, out.get((d, i), 0))
    return out


def test_whole_table(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rows = QUERIES["op8_decontamination"](spark, SF).collect()
    want = brute(documents(spark), items)
    assert want and {(r.doc_id, r.item_id): r.similarity for r in rows} == want


def test_substituted_passages(spark):
    rng = random.Random(4)
    items = {i: prose(rng, 30) for i in range(10)}
    texts = {}
    for d in range(60):
        passage = items[d % 10].split()[: rng.choice([15, 20, 30])]
        for at in rng.sample(range(len(passage)), rng.randrange(5)):
            passage[at] = prose(rng, 1)
        texts[d] = f"{prose(rng, 50)} {', '.join(passage).upper()}. {prose(rng, 50)}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute(texts, items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert len(want) > 30 and got == set(want)
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == set(texts) - {d for d, _ in want}


def test_without_broadcasts_and_short_items(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "say the magic word now"), (2, "the word magic"), (3, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Magic word!"), (2, ""), (3, None), (None, "x"), (1, "Magic word!")], "item_id long, text string")
    for limit in (0, 1000):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
        rows = decontaminate.leaks(docs, bench).collect()
        assert sorted((r.doc_id, r.item_id or 0, r.start, r.end) for r in rows) == [(1, 1, 2, 4), (1, 1, 2, 4), (3, 0, 0, 1)]


def test_awkward_rows(spark):
    df = awkward(spark)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - 1
    assert decontaminate.clean(df, bench.limit(0)).count() == df.count()
    assert decontaminate.clean(empty(spark), bench).count() == 0 == decontaminate.leaks(empty(spark), bench).count()


def test_allowed_substitutions_in_short_items(spark):
    items, docs = [], []
    for n in range(1, 13):
        words = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        wrong = n - -(-n * 4 // 5)
        for places in combinations(range(n), wrong):
            text = " ".join("other" if i in places else w for i, w in enumerate(words))
            docs.append((len(docs), n, f"before {text} after"))
    df = spark.createDataFrame([(d, t) for d, _, t in docs], "doc_id long, text string")
    found = decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(d, n) for d, n, _ in docs}
