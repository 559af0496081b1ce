"""Chat formatting: a hidden Markov model recovers the turns of raw transcripts.

Hidden states say who speaks and whether a line begins a turn or goes on with it.
Observed are, for each line, its speaker marker, whether it is blank, follows a blank
line, asks a question, and how long it is. Start, transition and emission weights are
counted from transcripts with known roles; Viterbi finds the best path through a whole
transcript, and the turns are rendered in one canonical form.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tableferry.llm.common import fold

ROLES = ("system", "user", "assistant")
#: Two states for each role: a line that begins a turn, a line that continues it.
STATES = tuple((role, begins) for role in ROLES for begins in (True, False))
#: Words that name a speaker at the start of a line.
SPEAKERS = {
    "system": ("system", "context", "setting"),
    "user": ("user", "human", "question", "q", "instruction", "prompt", "customer"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "response", "agent"),
}
ROLE_OF = {word: role for role, words in SPEAKERS.items() for word in words}
MARKER = re.compile(r"^[\s#*<\[(|>-]{0,6}([A-Za-z]{1,12})[*\])|>]{0,4}\s*(?::|>|\]|\)|$)[*\s|>]*")
#: Transcripts that are collected for learning, at most.
SAMPLE = 2_000
#: Turns of one segment: longer conversations are transcribed in segments of this many turns.
SEGMENT = 64


def marker(line: str) -> tuple[str, int]:
    """The role that a line's marker names ('' if none), and the marker's length."""
    found = MARKER.match(line)
    if found:
        role = ROLE_OF.get(found[1].lower(), "")
        closed = found[0].strip().lower() != found[1].lower() or len(found[1]) > 2
        if role and closed:
            return role, found.end()
    return "", 0


#: Values of each observed feature.
SIZES = (4, 2, 2, 3)


def observed(lines: list[str]) -> list[tuple[int, ...]]:
    out, blank_before = [], 1
    for line in lines:
        role, _ = marker(line)
        text = line.strip()
        length = 0 if not text else 1 if len(text) < 120 else 2
        out.append((("", *ROLES).index(role), blank_before, int(text.endswith("?")), length))
        blank_before = int(not text)
    return out


@dataclass(frozen=True)
class Model:
    """Logarithms of the start, transition and emission probabilities."""

    start: np.ndarray
    moves: np.ndarray
    emits: tuple[np.ndarray, ...]

    def path(self, lines: list[str]) -> list[int]:
        """The most likely state of each line; of equal paths, that of the earlier states."""
        if not lines:
            return []
        scores = [sum(e[:, v] for e, v in zip(self.emits, row, strict=True)) for row in observed(lines)]
        best, back = self.start + scores[0], []
        for s in scores[1:]:
            through = best[:, None] + self.moves
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + s
        states = [int(best.argmax())]
        for pointers in reversed(back):
            states.append(int(pointers[states[-1]]))
        return states[::-1]


def learn(examples: list[tuple[list[str], list[int]]]) -> Model:
    """Counts of lines with known states, each raised by a half."""
    n = len(STATES)
    start, moves = np.full(n, 0.5), np.full((n, n), 0.5)
    emits = [np.full((n, size), 0.5) for size in SIZES]
    for lines, states in examples:
        for k, (row, state) in enumerate(zip(observed(lines), states, strict=True)):
            if k:
                moves[states[k - 1], state] += 1
            else:
                start[state] += 1
            for e, v in zip(emits, row, strict=True):
                e[state, v] += 1
    share = lambda a: np.log(a / a.sum(axis=-1, keepdims=True))
    return Model(share(start), share(moves), tuple(share(e) for e in emits))


def turns(text: str | None, model: Model) -> list[tuple[str, str]]:
    """Role and text of each turn, markers taken off. A text without a turn gives none."""
    lines = (text or "").split("\n")
    if not any(line.strip() for line in lines):
        return []
    out: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, model.path(lines), strict=True):
        role, begins = STATES[state]
        if begins or not out or out[-1][0] != role:
            out.append((role, []))
        named, end = marker(line)
        out[-1][1].append(line[end:] if named == role and not any(out[-1][1]) else line)
    return [(role, "\n".join(body).strip()) for role, body in out if any(b.strip() for b in body)]


def render(found: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in found)


TURNS = "array<struct<role: string, text: string>>"


def parse(transcripts: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ``turns`` and ``rendered`` of every row.

    NULL, empty and blank texts have no turns and render as an empty text. Repeated rows
    stay; an empty table gives no rows; columns other than ``keep`` are left out.
    """
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def batches(frames):
        for batch in frames:
            found = [turns(t, model) for t in batch.column(len(keep)).to_pylist()]
            structs = pa.array([[{"role": r, "text": t} for r, t in row] for row in found], kind)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], structs, pa.array(map(render, found), pa.string())],
                [*keep, "turns", "rendered"],
            )

    narrow = transcripts.select(*keep, F.col(text).cast("string").alias("_text"))
    kept = [f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep]
    return narrow.mapInArrow(batches, ", ".join([*kept, f"turns {TURNS}", "rendered string"]))


#: Ways of marking speakers that raw transcripts come in: (system, user, assistant, after the marker).
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("[system] ", "[human] ", "[bot] "),
    ("### System\n", "### Instruction\n", "### Response\n"),
    ("**Context:** ", "**Q:** ", "**A:** "),
    ("<system> ", "<customer> ", "<agent> "),
)


def raw_transcripts(conversations: DataFrame, missing: float = 0.15) -> DataFrame:
    """Transcripts as they are found in the wild, of conversations with known roles.

    A hash of the conversation chooses the style; a share ``missing`` of the turns, by the
    hash of conversation and turn, has lost its marker, after a blank line. Returns
    ``conv_id``, ``segment``, ``text``, ``states`` (of each line) and ``roles`` (of each
    turn). Turns without text or with another role are left out; turns are ordered by
    number, role and text; a conversation is cut into segments of ``SEGMENT`` turns.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    mark = F.lit("")
    for i, role in enumerate(ROLES):
        mark = F.when(F.col("role") == role, F.get(F.array(*[F.lit(s[i]) for s in STYLES]), style)).otherwise(mark)
    lost = F.pmod(F.xxhash64("conv_id", "turn", F.lit("lost")), F.lit(1000)) < int(missing * 1000)
    place = F.lit(0)
    for i, role in enumerate(ROLES):
        place = F.when(F.col("role") == role, F.lit(2 * i)).otherwise(place)
    told = (
        conversations.where(F.col("text").isNotNull() & F.col("role").isin(*ROLES))
        .withColumn("marked", F.concat(F.when(lost, F.lit("\n")).otherwise(mark), F.col("text")))
        .select(
            "conv_id",
            F.floor(F.coalesce("turn", F.lit(0)) / SEGMENT).alias("segment"),
            F.struct(
                F.coalesce("turn", F.lit(0)).alias("turn"), "role", "marked",
                F.transform(F.split("marked", "\n", -1), lambda _, i: place + F.when(i == 0, 0).otherwise(1)).alias("states"),
            ).alias("one"),
        )
    )
    ordered = told.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return ordered.select(
        "conv_id",
        "segment",
        F.array_join("all.marked", "\n").alias("text"),
        F.flatten("all.states").alias("states"),
        F.col("all.role").alias("roles"),
    )


def train(transcripts: DataFrame, key: str = "conv_id", sample: int = SAMPLE) -> Model:
    """A model of at most ``sample`` transcripts outside fold 1, those of the smallest key hashes."""
    rows = (
        transcripts.where(F.coalesce(fold(key) != 1, F.lit(False)))
        .orderBy(F.xxhash64(key), "segment")
        .select("text", "states")
        .limit(sample)
        .collect()
    )
    return learn([(text.split("\n"), states) for text, states in rows])
