import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from helpers import SF, awkward, documents, empty
from tokenizers import Tokenizer

from tableferry.llm import packing
from tableferry.llm.queries import QUERIES

EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts):
    ids = {d: np.array(EXACT.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for d, t in texts.items()}
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.start, len(part), zlib.crc32(part.tobytes()), len(ids[r.doc_id])) == (at[r.doc_id], r.length, r.ids_crc32, r.doc_tokens)
        at[r.doc_id] += r.length
    assert at == Counter({d: len(x) for d, x in ids.items()})
    layout(rows)


def layout(rows):
    end = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end[r.sequence_id]
        end[r.sequence_id] += r.length
    assert max(end.values()) <= 1024
    return end


def test_whole_table(spark):
    rows = QUERIES["op3_packing"](spark, SF).collect()
    check(rows, documents(spark))
    end = layout(rows)
    assert sum(1024 - n for n in end.values() if n & (n - 1)) < 0.03 * sum(end.values())


def test_fast_and_exact_ids_agree():
    texts = ["", " ", "a  b\n\n c\t\td", "It's we'll I'M 'tis", "naïve façade — “quotes” …", "漢字 and 😀", "x<|endoftext|>y", "1234 5a6b", "\x00\x01", "tail  \n ", "ǅ ß ſ İ"]
    for t in texts:
        assert packing.token_ids(t).tolist() == EXACT.encode(t, add_special_tokens=False).ids + [0], t


def test_knapsack_and_plans():
    rng = random.Random(0)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(1, 13), 4)))
        prices = np.array([rng.random() for _ in lengths])
        value, counts = packing.knapsack(prices, lengths, 12)
        most = max(
            (sum(k * p for k, p in zip(ks, prices)) for ks in itertools.product(range(13), repeat=4) if sum(k * n for k, n in zip(ks, lengths)) <= 12),
        )
        assert abs(value - most) < 1e-9 and counts @ lengths <= 12 and abs(counts @ prices - value) < 1e-9
    for _ in range(10):
        demand = {n: rng.randrange(1, 2000) for n in rng.sample(range(1, 257), 60)}
        plan, got = packing.cutting_stock(demand, 256), Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 256 and times > 0
            for n in pattern:
                got[n] += times
        assert got == demand
        assert sum(t for _, t in plan) <= sum(t for _, t in packing.best_fit(demand, 256)) + len(demand)
    assert packing.cutting_stock({}, 256) == []


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = packing.pack(df).collect()
    layout(rows)
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * len(EXACT.encode("one").ids) + 2
    assert [(r.start, r.length, r.doc_tokens) for r in rows if r.doc_id in (1, 2)] == [(0, 1, 1)] * 2
    assert packing.pack(empty(spark)).count() == 0
