"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, and one on the over-represented
pieces of words in toxic text. Every window of a text is compressed twice, with the
ordinary dictionary and with the toxic one before it; the bytes that the toxic
dictionary saves are the distance. Windows of ordinary text save nothing, a toxic word
saves two to ten bytes. Shares and counts of windows above each threshold are calibrated
to a probability on the labelled sample.

Text is spelled so that every letter depends on its place in its word. A dictionary
entry then matches at the same place of a word only, and not the same letters elsewhere.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tableferry.llm.common import fold, labelled_sample

#: Labelled documents of each class that are collected for learning, at most.
SAMPLE_PER_CLASS = 2_000
#: Words of a window.
WINDOW = 16
LEVEL = 9
#: Bytes of the dictionaries; the toxic one is trained in rounds, each on what is not yet covered.
ORDINARY_BYTES, TOXIC_BYTES, ROUND_BYTES, ROUNDS = 16_000, 1_024, 512, 3
#: A piece of this many bytes is over-represented from this many standard errors on.
PIECE, STANDARD_ERRORS, TIMES = 5, 5.0, 3.0
#: Saved bytes from which a window counts, one threshold after the other.
THRESHOLDS = (1, 2, 3, 4, 5, 6)
TOXIC_FROM = 0.7

BLANK = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))


def spelled(text: str, size: int) -> list[bytes]:
    """Windows of ``size`` words, letters shifted by their place in the word; whole text."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    blank = BLANK[data]
    index = np.arange(len(data))
    place = np.minimum(index - np.maximum.accumulate(np.where(blank, index, 0)), 24)
    out = np.where(blank, 32, (data + 41 * place) & 255).astype(np.uint8).tobytes()
    starts = np.flatnonzero(~blank[1:] & blank[:-1])
    cuts = [*starts[::size].tolist(), len(data)]
    return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def pieces(word: bytes) -> set[bytes]:
    return {word[i : i + PIECE] for i in range(len(word) - PIECE + 1)}


def spelled_words(text: str) -> list[bytes]:
    return [b" " + w.strip(b" ") + b" " for w in spelled(text, 1)]


def over_represented(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[bytes]:
    """Pieces that are in far more toxic than ordinary documents, by a two-sample z-test."""
    counts = []
    for documents in (toxic, ordinary):
        seen: Counter[bytes] = Counter()
        for words in documents:
            seen.update(set().union(*map(pieces, set(words))))
        counts.append(seen)
    nt, no, found = len(toxic), len(ordinary), set()
    for piece, x in counts[0].items():
        y = counts[1][piece]
        p = (x + y) / (nt + no)
        error = np.sqrt(p * (1 - p) * (1 / nt + 1 / no))
        if x >= 3 and error and (x / nt - y / no) / error >= STANDARD_ERRORS and x / nt > TIMES * y / no:
            found.add(piece)
    return found


def trained(samples: list[bytes], size: int, segment: int, least: int) -> bytes:
    """Content of a zstandard dictionary; of too few samples, the samples themselves."""
    try:
        return zstandard.train_dictionary(size + 256, samples, k=segment, d=least).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


@dataclass(frozen=True)
class Model:
    """Dictionary contents, and the calibration: centre, scale and weight of each feature."""

    ordinary: bytes
    toxic: bytes
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        contents = (model.ordinary, model.toxic + model.ordinary)
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=WINDOW * 9, dict_size=max(map(len, contents)), min_match=4,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self.compress = []
        for content in contents:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=parameters)
            self.compress.append(zstandard.ZstdCompressor(dict_data=held, compression_params=parameters).compress)

    def features(self, text: str | None) -> list[float]:
        """Shares and counts of windows by saved bytes; an empty text has one empty window."""
        windows = spelled(text or "", WINDOW)
        one, two = self.compress
        saved = np.array([len(one(w)) - len(two(w)) for w in windows] or [0])
        above = [(saved >= t) for t in THRESHOLDS]
        return [
            *(float(a.mean()) for a in above),
            float(saved.mean()),
            *(float(np.log1p(a.sum())) for a in above[1:]),
            float(np.log1p(len(saved))),
            float(min(saved.max(), 12)),
        ]

    def scores(self, features: np.ndarray) -> np.ndarray:
        m = self.model
        if not m.weights:
            return np.zeros(len(features))
        scaled = (features - np.array(m.centre)) / np.array(m.scale)
        return 1 / (1 + np.exp(-np.clip(m.weights[0] + scaled @ np.array(m.weights[1:]), -50, 50)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a penalised logistic regression, by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(toxic: list[str], ordinary: list[str], prior: float | None = None) -> Model:
    """A model of two lists of texts; without a text in one of them all scores are 0.

    ``prior`` is the share of toxic documents at large, if the lists do not show it.
    """
    if not toxic or not ordinary:
        return Model(b"", b"")
    bad, good = [spelled_words(t) for t in toxic], [spelled_words(t) for t in ordinary]
    telling = over_represented(bad, good)
    hits: list[list[bytes]] = []
    for words in bad:
        found = []
        for w in words:
            at = [i for i in range(len(w) - PIECE + 1) if w[i : i + PIECE] in telling]
            if at:
                found.append(w[at[0] : at[-1] + PIECE])
        if found:
            hits.append(found)
    content = trained([b"".join(h) for h in hits], TOXIC_BYTES, 16, 6) if hits else b""
    for _ in range(ROUNDS):
        rest = [b"".join(w for w in h if w.strip(b" ") not in content) for h in hits]
        if any(rest):
            content = trained([r for r in rest if r], ROUND_BYTES, 16, 6) + content
    common = trained([w for t in ordinary for w in spelled(t, 12)], ORDINARY_BYTES, 32, 8)
    plain = Scorer(Model(common, content))
    x = np.array([plain.features(t) for t in toxic + ordinary])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = logistic((x - centre) / scale, y)
    if prior is not None and 0 < prior < 1:  # classes were sampled apart
        weights[0] += np.log(prior / (1 - prior)) - np.log(len(toxic) / len(ordinary))
    return Model(common, content, tuple(centre), tuple(scale), tuple(weights))


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS
) -> Model:
    """A model of a bounded sample of labelled documents outside fold 1."""
    rows = labelled_sample(docs, labels, label, per_class).select("doc_id", "_label", "text").collect()
    rows = sorted((r[0], r[1], r[2] or "") for r in rows)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id") != 1))
    shares = known.agg(F.avg(label)).first()  # one row
    return learn([r[2] for r in rows if r[1]], [r[2] for r in rows if not r[1]], shares[0])


@lru_cache(maxsize=2)
def scorer(model: Model) -> Scorer:
    return Scorer(model)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ``score`` (0 to 1) and ``predicted`` (1 from ``TOXIC_FROM`` on) of every row.

    NULL and empty texts are scored as one window without words. Repeated rows stay; an
    empty table gives no rows; columns other than ``keep`` are left out.
    """

    def batches(frames):
        for batch in frames:
            s = scorer(model)
            x = np.array([s.features(t) for t in batch.column(len(keep)).to_pylist()])
            scores = s.scores(x) if len(x) else np.zeros(0)
            predicted = pa.array((scores >= TOXIC_FROM).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(scores, pa.float64()), predicted], [*keep, "score", "predicted"]
            )

    narrow = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kept = [f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep]
    return narrow.mapInArrow(batches, ", ".join([*kept, "score double, predicted int"]))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic."""
    columns = docs.columns
    renamed = docs.toDF(*[f"_c{i}" for i in range(len(columns))])
    at = columns.index(text)
    scored = score(renamed, model, renamed.columns, f"_c{at}")
    return scored.where("predicted = 0").drop("score", "predicted").toDF(*columns)
