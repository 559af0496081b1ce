import itertools

import numpy as np
from helpers import SF, awkward, empty

from tableferry.llm import transcripts
from tableferry.llm.queries import QUERIES

EXAMPLES = [
    ("System: be kind\nUser: hello?\nmore words\nAssistant: yes\nand more\n\nUser: bye", [0, 2, 3, 4, 5, 5, 2]),
    ("User: what?\nAssistant: that\n\nwhy is it so?\nAssistant: because", [2, 4, 5, 2, 4]),
    ("### Instruction\ndo it\n### Response\ndone\nreally", [2, 3, 4, 5, 5]),
]


def model():
    return transcripts.learn([(t.split("\n"), s) for t, s in EXAMPLES])


def test_viterbi_finds_the_best_of_all_paths():
    m = model()
    for text in ("User: a?\nb\nBot: c", "x\n\ny?\nAssistant: z", "a"):
        lines = text.split("\n")
        seen = transcripts.observed(lines)

        def weight(path):
            w = m.start[path[0]] + sum(m.moves[a, b] for a, b in itertools.pairwise(path))
            return w + sum(e[s, v] for s, row in zip(path, seen) for e, v in zip(m.emits, row))

        best = max(itertools.product(range(len(transcripts.STATES)), repeat=len(lines)), key=weight)
        assert np.isclose(weight(m.path(lines)), weight(best))


def test_markers():
    for line, role in {
        "User: hi": "user", "[bot] hi": "assistant", "### Response": "assistant", "**Q:** hi": "user", "<agent> hi": "assistant",
        "a: hi": "assistant", "a house": "", "question of taste": "", "Note: hi": "", "": "", "System": "system",
    }.items():
        assert transcripts.marker(line)[0] == role, line


def test_turns_are_rendered_without_markers():
    found = transcripts.turns("User: hello?\nmore\nAssistant: yes", model())
    assert found == [("user", "hello?\nmore"), ("assistant", "yes")]
    assert transcripts.render(found) == "<|user|>\nhello?\nmore\n<|end|>\n<|assistant|>\nyes\n<|end|>\n"


def test_held_out_transcripts(spark):
    rows = QUERIES["op4_chat_format"](spark, SF.replace("0.001", "0.1")).where("held_out").collect()
    assert len(rows) > 200 and np.mean([r.roles_found == r.roles_told for r in rows]) > 0.95


def test_awkward_rows(spark):
    rows = transcripts.parse(awkward(spark), model(), ["doc_id"]).collect()
    assert len(rows) == awkward(spark).count()
    assert all(r.turns == [] and r.rendered == "" for r in rows if r.doc_id in (1, 2, 3))
    assert transcripts.parse(empty(spark), model(), ["doc_id"]).count() == 0
    none = spark.createDataFrame([(None, None, None, None), (1, None, "user", "x"), (1, None, "user", "x"), (2, 1, "other", "y")],
                                 "conv_id long, turn long, role string, text string")
    raw = transcripts.raw_transcripts(none).collect()
    assert [(r.conv_id, r.roles) for r in raw] == [(1, ["user", "user"])]
    assert transcripts.train(transcripts.raw_transcripts(none.limit(0))).path(["x"])
