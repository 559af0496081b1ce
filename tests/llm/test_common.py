import random

from helpers import union_find

from tableferry.llm import common, decontaminate, linededup, neardup, simhash


def test_components_of_random_graphs_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2400)] + [(5, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == union_find(nodes, [e for e in edges if e[0] != e[1]])
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranks_are_gapless_though_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(common, "RANK_ROWS", 7)
    df = spark.createDataFrame([(i % 2 * (i % 3), i // 2) for i in range(200)], "k int, v int")
    by = {}
    for r in common.ranked(df, ["k"], ["v"]).collect():
        by.setdefault(r.k, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 200


def test_columns_may_be_called_as_operators_call_theirs(spark):
    """Every row comes back with its own values, whatever its columns are called."""
    inner = "_hash _h _r _key _rest _text _gone _gone_key _gone_doc _leak _doc _o _n root id code c0 c1 fingerprint doc item print".split()
    texts = ["one line of a text\nand another one", "one line of a text", "something else entirely, and long enough to count as words", None]
    rows = [(i, t, *[f"{n}{i}" for n in inner]) for i, t in enumerate(texts)]
    schema = ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in inner]])
    df = spark.createDataFrame(rows, schema)
    benchmark = spark.createDataFrame([(1, "something else entirely, and long enough to count as words")], "item_id long, text string")
    for out, ids in (
        (linededup.deduplicated(df, dropped="n"), [0, 1, 2, 3]), (neardup.near_duplicates_dropped(df), [0, 1, 2, 3]),
        (simhash.one_of_each(df), [0, 1, 2, 3]), (decontaminate.clean(df, benchmark), [0, 1, 3]),
    ):
        assert out.columns[: len(df.columns)] == df.columns
        got = sorted(map(tuple, out.collect()))
        assert [r[0] for r in got] == ids
        assert all(r[2 : len(df.columns)] == rows[r[0]][2:] for r in got)
