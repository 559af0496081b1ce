import random
import zlib

import numpy as np
from helpers import SF, awkward, empty, prose

from tableferry.llm import toxicity
from tableferry.llm.queries import QUERIES


def corpus(n, toxic, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = prose(rng, 120).split()
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbleface", "snotwaffle", "drivelmonger"]))
        out.append(" ".join(words))
    return out


def test_planted_words_are_found_and_clean_text_is_left():
    model = toxicity.learn(corpus(60, True, 1), corpus(200, False, 2))
    s = toxicity.Scorer(model)
    scores = lambda texts: s.scores(np.array([s.features(t) for t in texts]))
    assert (scores(corpus(40, True, 3)) >= toxicity.TOXIC_FROM).mean() >= 0.9
    assert (scores(corpus(200, False, 4)) < toxicity.TOXIC_FROM).all()
    assert b"" .join(toxicity.spelled("a bc  d\ne f", 2)).count(b" ") == 6


def test_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    found = QUERIES["op2_toxicity"](spark, sf)
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    auc = np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])
    assert auc > 0.8 and ((s >= 0.7) & (y == 0)).sum() <= 0.05 * (y == 0).sum()
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_awkward_rows(spark):
    model = toxicity.learn(corpus(30, True, 1), corpus(60, False, 2))
    rows = toxicity.score(awkward(spark), model, ["doc_id"]).collect()
    assert len(rows) == awkward(spark).count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    kept = toxicity.drop_toxic(awkward(spark), model)
    assert kept.columns == awkward(spark).columns and kept.count() == sum(1 - r.predicted for r in rows)
    assert toxicity.score(empty(spark), model, ["doc_id"]).count() == 0
    nothing = toxicity.learn([], ["x"])
    assert {r.score for r in toxicity.score(awkward(spark), nothing, ["doc_id"]).collect()} == {0.0}
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(awkward(spark), labels).weights == ()


def test_prior_ignores_labels_of_fold_1(spark):
    docs = spark.createDataFrame([(i, f"plain words of text number {i} " + ("nasty slur " * 3 if i % 4 == 0 else "")) for i in range(120)], "doc_id long, text string")
    marked = [(i, int(i % 4 == 0)) for i in range(120)]
    held = [(i, 1 if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in marked] + [(None, 1)]
    schema = "doc_id long, toxic int"
    first, second = (toxicity.train(docs, spark.createDataFrame(rows, schema)) for rows in (marked, held))
    assert first == second
