import re
from collections import Counter, defaultdict

import numpy as np
from helpers import SF

from tableferry.llm import divergence
from tableferry.llm.queries import QUERIES


def brute(rows):
    """Every row of the audit, in whole numbers of any size."""
    docs = defaultdict(list)
    for text, lang, source in rows:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        docs[lang or ""].append((source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)))
    out = []
    for lang, found in docs.items():
        inside = Counter(t for _, terms in found for t in set(terms))
        kept = {t for t, n in inside.items() if n >= 3}
        counts = {s: Counter() for s, _ in found}
        for s, terms in found:
            counts[s].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        far = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-far(p[s][t], q[t]), t.encode(), t) for t in counts[s] if p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out += [(lang, s, part, item, -value, i) for i, (value, _, item) in enumerate(ranked, 1)]
    return sorted(out)


def audited(df):
    return sorted(map(tuple, divergence.audit(df).collect()))


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source").collect()]
    assert sorted(map(tuple, QUERIES["op13_source_divergence"](spark, SF).collect())) == brute(rows)


SCHEMA = "text string, lang string, source string, term string, docs string, counts long, block string, n string, value string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1, "c", "d", "e") for r in rows], SCHEMA)


def test_awkward_rows(spark):
    long = " ".join(f"{'word' * 30}{i % 97}Ünï漢{i % 89}" for i in range(60_000))  # cut into pieces
    rows = [
        (None, None, None), ("", "", ""), ("one two", None, "a"), ("One TWO", "", "a"), ("one two three", None, None), ("1 2 3 !", "en", "x"),
        ("É é İ ǅ one", "en", "y"), ("É é one", "en", "y"), ("É one", "en", None), ("É one one", "en", "x"), (long, "long", "a"), (long, "long", "b"),
        (long + " more", "long", "a"), ("one", "alone", "only"), ("one", "alone", "only"), ("one", "alone", "only"), ("a-b_c`d{e", "en", "z"),
        *[("same same text", "de", f"s{i % 5}") for i in range(20)], *[("a b", "nul", "s\x00t")] * 3,
    ]
    df = frame(spark, rows)
    assert audited(df) == brute(rows)
    assert audited(df.limit(0)) == []


def test_small_tables_and_blocks_of_stripes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [
        (" ".join(f"w{'abcdefghij'[k % 10]}{'klmnop'[k % 6]}" for k in rng.geometric(0.03, 40)), "en" if i % 9 else "fr", f"s{min(i % 11, 6)}")
        for i in range(200)
    ]
    want = brute(rows)
    df = frame(spark, rows).repartition(7)
    monkeypatch.setattr(divergence, "HELD", 25)
    monkeypatch.setattr(divergence, "BLOCK", 100)
    monkeypatch.setattr(divergence, "CELLS", 60)
    monkeypatch.setattr(divergence, "SHOWN", 200)
    # the tasks see the values of their own interpreter, so the folding is also called here
    assert audited(df) == want
    batches = df.select("text", "lang", "source").toArrow().to_batches()
    parts = [b for b in divergence._folded(iter(batches))]
    assert len(parts) > 50
    rows = sorted((r for b in parts for r in b.to_pylist()), key=lambda r: (r["lang"], r["term"]))
    import pyarrow as pa

    schema = parts[0].schema
    merged = [r for b in divergence._merged(pa.RecordBatch.from_pylist(rows[i : i + 13], schema) for i in range(0, len(rows), 13)) for r in b.to_pylist()]
    keys = [(r["lang"], r["term"]) for r in merged]
    assert len(keys) == len(set(keys))
    docs = Counter()
    for text, lang, _ in frame(spark, []).select("text", "lang", "source").union(df.select("text", "lang", "source")).collect():
        docs.update((lang, t) for t in set(divergence.TERM.findall(text)))
    assert {(r["lang"], r["term"]): r["docs"] for r in merged} == dict(docs)


def test_shares_of_huge_counts():
    counts = np.array([0, 1, 7, 9_000_000_000_000, 9_000_000_000_000_000 - 5])
    totals = np.array([9_000_000_000_000_000, 3, 8, 9_000_000_000_001, 9_000_000_000_000_000])
    want = [1 + 10**9 * (int(c) + 1) // int(n) for c, n in zip(counts, totals)]
    assert divergence.shares(counts, totals).tolist() == want
