"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cut greedily
into the longest phrases that occur in the labelled text; the fewer phrases per
character, the closer the language. Automata are small dense tables, and many windows of
text walk through a table in step, so the work is a few array operations per character.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tableferry.llm.common import fold

#: Labelled text per language: documents that are collected (expected number), and
#: characters that are kept of them.
SAMPLE_DOCS = 200
TRAIN_CHARS = 24_000
#: Letters that are told apart; rarer ones share a class that matches nothing.
LETTERS = 120
#: A parse starts anew at every window, so long texts take no longer steps than short ones.
WINDOW = 256
#: Characters that are parsed at once.
BATCH_CHARS = 2_000_000
#: Score: weight of a bit of entropy per character.
SHARPNESS = 2.0
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Language labels in order, their labelled text, and the letters told apart."""

    languages: tuple[str, ...]
    texts: tuple[str, ...]
    letters: str


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the labelled documents outside fold 1.

    One pass over labels and keys counts the languages, a second collects whole texts of
    about ``SAMPLE_DOCS`` documents each, chosen by the hash of their keys.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.coalesce(fold(key) != 1, F.lit(False)))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}  # one row per language
    if not counts:
        return Model((), (), "")
    share = F.lit(0.0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col(lang) == name, F.lit(min(1.0, SAMPLE_DOCS / n))).otherwise(share)
    place = F.pmod(F.xxhash64(key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = labelled.where(place < share).select(lang, F.xxhash64(key), text).collect()
    kept: dict[str, str] = {}
    for name, _, words in sorted(tuple(r) for r in rows):
        if len(kept.setdefault(name, "")) < TRAIN_CHARS:
            kept[name] += plain(words) + " "
    return model({name: t[:TRAIN_CHARS] for name, t in kept.items()})


def model(texts: dict[str, str]) -> Model:
    """A model of given texts per language."""
    names = sorted(texts)
    seen = Counter(c for t in texts.values() for c in plain(t) if c != " ")
    letters = "".join(sorted(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]))
    return Model(tuple(names), tuple(plain(texts[n]) for n in names), letters)


def plain(text: str) -> str:
    """Lower-case letters; any run of other characters is one space."""
    return "".join(c if c.isalpha() else " " for c in " ".join(text.lower().split()))


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the states of the smallest automaton of all substrings; state 0 is the start."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return moves


class Parser:
    """Tables of a model, as a worker holds them."""

    def __init__(self, m: Model):
        self.model = m
        n = len(m.letters)
        self.other, self.pad, self.width = n + 1, n + 2, n + 3
        self.classes = np.zeros(0x110000, dtype=np.uint8)
        self.classes[[c for c in range(0x110000) if chr(c).isalpha()]] = self.other
        for i, c in enumerate(m.letters, 1):
            self.classes[ord(c)] = i
        self.tables = [self._table(t) for t in m.texts]
        self.bits = np.log2([max(2, len(t)) for t in m.texts]) if m.texts else np.zeros(0)

    def _table(self, text: str) -> np.ndarray:
        """Entry (state, class): the row after the step, doubled, plus 1 if a phrase begins.

        The last state stands before a phrase: every letter begins one there, and a letter
        that the labelled text lacks leads back to it.
        """
        moves = suffix_automaton(self.classes[[ord(c) for c in text]].tolist())
        start = np.full(self.width, len(moves), dtype=np.int32)
        for c, to in moves[0].items():
            if c != self.other:
                start[c] = to
        table = np.tile(start * self.width * 2 + 1, (len(moves) + 1, 1)).astype(np.int32)
        for s, out in enumerate(moves):
            for c, to in out.items():
                if c != self.other:
                    table[s, c] = to * self.width * 2
        table[:, self.pad] = np.arange(len(table)) * self.width * 2
        return table.ravel()

    def codes(self, text: str) -> np.ndarray:
        """Classes of the letters of a text, with one 0 for each run of other characters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.classes[points]
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        return codes[keep]

    def entropies(self, codes: list[np.ndarray]) -> np.ndarray:
        """Bits per character by text and language; texts must not be empty."""
        sizes = np.array([len(c) for c in codes])
        windows = -(-sizes // WINDOW)
        matrix = np.full((int(windows.sum()), WINDOW), self.pad, dtype=np.uint8)
        first = np.concatenate([[0], np.cumsum(windows)[:-1]])
        flat = matrix.reshape(-1)
        for at, c in zip(first * WINDOW, codes, strict=True):
            flat[at : at + len(c)] = c
        steps = np.ascontiguousarray(matrix.T).astype(np.int32)
        out = np.empty((len(codes), len(self.tables)))
        for k, table in enumerate(self.tables):
            at = np.full(len(matrix), len(table) // self.width - 1, dtype=np.int32) * (self.width * 2)
            phrases = np.zeros(len(matrix), dtype=np.int32)
            for step in steps:
                np.right_shift(at, 1, out=at)
                at += step
                at = table.take(at)
                phrases += at & 1
            out[:, k] = np.add.reduceat(phrases, first) * self.bits[k] / sizes
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.tables:
            return found
        rows, codes, held = [], [], 0
        for i, t in enumerate(texts):
            c = self.codes(t) if t else np.zeros(0, np.uint8)
            if c.any():
                rows.append(i)
                codes.append(c)
                held += len(c)
            if codes and (held >= BATCH_CHARS or i == len(texts) - 1):
                self._decide(rows, codes, found)
                rows, codes, held = [], [], 0
        if codes:
            self._decide(rows, codes, found)
        return found

    def _decide(self, rows: list[int], codes: list[np.ndarray], found: list[tuple[str, float]]) -> None:
        bits = self.entropies(codes)
        best = bits.argmin(axis=1)
        weights = np.exp(-SHARPNESS * (bits - bits.min(axis=1, keepdims=True)))
        scores = 1.0 / weights.sum(axis=1)
        for row, k, score in zip(rows, best, scores, strict=True):
            found[row] = (self.model.languages[k], float(score))


@lru_cache(maxsize=2)
def parser(m: Model) -> Parser:
    return Parser(m)


def identify(docs: DataFrame, m: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ``lang_pred`` and ``score`` (0 to 1) of every row.

    NULL texts, texts without a letter and an empty model give 'und' and 0. Equal
    entropies go to the language that sorts first. Repeated rows stay; an empty table
    gives no rows; columns other than ``keep`` are left out.
    """

    def batches(frames):
        for batch in frames:
            found = parser(m).predict(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())],
                [*keep, "lang_pred", "score"],
            )

    narrow = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kept = [f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep]
    return narrow.mapInArrow(batches, ", ".join([*kept, "lang_pred string, score double"]))
