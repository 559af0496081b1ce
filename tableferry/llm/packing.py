"""Packing documents into sequences by cutting stock with column generation.

Documents are cut into whole sequences and one remainder. How remainders of each length
go together is a linear program over patterns (multisets of lengths that fit into one
sequence): the restricted program is kept as a revised simplex basis, and a knapsack
dynamic program over its prices finds the next pattern, until the bound on the whole
program is within ``GAP``. Best-fit patterns are priced first, which makes a good start. Patterns are rounded down; what is left over, fewer pieces
than patterns times their sizes, is packed best-fit. Lengths count in units of ``UNIT``
ids, rounded up, which keeps the program small; offsets are made of the real lengths.
Only the histogram of at most ``capacity / UNIT`` lengths reaches the driver, however
many documents there are. Ranks of equal lengths then tell each document its pattern,
its sequence and its slot.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window as W, functions as F

from tableferry.llm.common import checkpoint, ranked

CAPACITY = 1024
END = 0
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Ids that a unit of length holds.
UNIT = 4
#: Relative distance to the bound at which pricing stops, and steps that it takes at most.
GAP, STEPS = 0.002, 4_000
#: Texts outside these characters, or with the special token's name, go to the slower library.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ–-„…]")
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=1)
def encoders(vocabulary: str = VOCABULARY, ranks: str = RANKS):
    """The tokenizer itself, and the same vocabulary in a library five times as fast."""
    exact = tokenizers.Tokenizer.from_file(public_tokenizers.path(vocabulary))
    with open(public_tokenizers.path(ranks), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}
    )
    return exact, fast


def token_ids(text: str | None) -> np.ndarray:
    """Ids of a whole text, and ``END``. NULL counts as empty."""
    exact, fast = encoders()
    text = text or ""
    if SPECIAL in text or PLAIN.search(text):
        ids = exact.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_ordinary(text)
    out = np.empty(len(ids) + 1, dtype="<u4")
    out[:-1] = ids
    out[-1] = END
    return out


def pieces(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``start``, ``length``, ``ids_crc32``, ``doc_tokens``."""

    def batches(frames):
        for batch in frames:
            rows = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = token_ids(t)
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    rows.append((i, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            table = np.array(rows, dtype=np.int64).reshape(-1, 5)
            keys = batch.column(0).take(pa.array(table[:, 0]))
            yield pa.RecordBatch.from_arrays(
                [keys, *(pa.array(table[:, c]) for c in range(1, 5))],
                [key, "start", "length", "ids_crc32", "doc_tokens"],
            )

    narrow = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    kind = narrow.schema[key].dataType.simpleString()
    return narrow.mapInArrow(
        batches, f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    )


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of largest value: counts by length, repeats allowed."""
    by_length = np.full(capacity + 1, -1.0)
    by_length[lengths] = prices
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        options = value[c - 1 :: -1] + by_length[1 : c + 1]
        k = int(options.argmax())
        value[c], choice[c] = value[c - 1], 0
        if options[k] > value[c] + 1e-12:
            value[c], choice[c] = options[k], k + 1
    counts, c = Counter(), capacity
    while c > 0:
        if choice[c]:
            counts[int(choice[c])] += 1
        c -= int(choice[c]) or 1
    return float(value[capacity]), np.array([counts[int(n)] for n in lengths], dtype=float)


def best_fit(demand: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used: longest lengths first, then the longest that fit.

    Works on counts: a pattern is used as often as its lengths last, so the number of
    patterns does not grow with the counts.
    """
    left, out = {n: k for n, k in demand.items() if k > 0}, []
    while left:
        room, pattern, counts = capacity, [], Counter()
        for n in sorted(left, reverse=True):
            k = min(left[n], room // n)
            if k:
                counts[n], room = k, room - n * k
                pattern += [n] * k
        times = min(left[n] // k for n, k in counts.items())
        out.append((tuple(pattern), times))
        for n, k in counts.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def cutting_stock(demand: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns, each with the number of sequences cut by it, that meet ``demand`` exactly."""
    lengths = np.array(sorted(n for n, k in demand.items() if k > 0), dtype=np.int64)
    if not len(lengths):
        return []
    wanted = np.array([demand[int(n)] for n in lengths], dtype=float)
    m = len(lengths)
    fits = capacity // lengths
    columns = [np.eye(m)[i] * fits[i] for i in range(m)]
    inverse = np.diag(1.0 / fits)
    used = wanted / fits
    first = [Counter(pattern) for pattern, _ in best_fit(demand, capacity)]
    pool = np.array([[counts[int(n)] for n in lengths] for counts in first], dtype=float)
    bound = 0.0
    for _ in range(STEPS):
        prices = inverse.sum(axis=0)  # every pattern costs one sequence
        known = pool @ prices
        column = pool[known.argmax()]
        if known.max() <= 1 + 1e-6:
            value, column = knapsack(prices, lengths, capacity)
            bound = max(bound, (prices @ wanted) / max(value, 1.0))  # of every packing, from below
            if used.sum() <= (1 + GAP) * bound:
                break
        direction = inverse @ column
        ratios = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1.0), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        used = np.maximum(used - ratios[out] * direction, 0.0)
        used[out] = ratios[out]
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        columns[out] = column
    left = {int(n): int(k) for n, k in zip(lengths, wanted, strict=True)}
    plan = []
    for column, times in zip(columns, np.floor(used + 1e-7).astype(int), strict=True):
        counts = {int(n): int(k) for n, k in zip(lengths, column, strict=True) if k}
        times = min([int(times), *(left[n] // k for n, k in counts.items())])
        if times > 0:
            plan.append((tuple(n for n, k in sorted(counts.items(), reverse=True) for _ in range(k)), times))
            for n, k in counts.items():
                left[n] -= k * times
    return plan + best_fit(left, capacity)


@dataclass(frozen=True)
class Places:
    """For a length, by rank: the runs of pieces that one pattern takes."""

    first: np.ndarray  # rank of the first piece of a run
    sequence: np.ndarray  # first sequence of the pattern
    slot: np.ndarray  # slot of the length's first piece in it
    each: np.ndarray  # pieces of the length in one sequence


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, Places]:
    """Where ranks go; as large as the patterns, not as the counts."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    upto: Counter[int] = Counter()
    sequence = 0
    for pattern, times in plan:
        slot = 0
        for n, k in sorted(Counter(pattern).items(), reverse=True):
            runs.setdefault(n, []).append((upto[n], sequence, slot, k))
            upto[n] += k * times
            slot += k
        sequence += times
    return {n: Places(*(np.array(c, dtype=np.int64) for c in zip(*r, strict=True))) for n, r in runs.items()}


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    Returns ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``
    and ``offset``. NULL and empty texts are the one id ``END``. Repeated rows are packed
    each; an empty table gives no rows; other columns are left out. Pieces of one length
    are ranked by key, start, checksum and length of document. ``capacity`` has to be a
    multiple of ``UNIT``.
    """
    cut = checkpoint(pieces(docs, key, text, capacity).withColumn("units", F.ceil(F.col("length") / UNIT)))
    demand = {r[0]: r[1] for r in cut.groupBy("units").count().collect()}  # capacity / UNIT rows at most
    found = places(cutting_stock(demand, capacity // UNIT))
    order = ranked(cut, ["units"], [key, "start", "ids_crc32", "doc_tokens"])
    kept = [key, "start", "length", "ids_crc32", "doc_tokens"]

    def batches(frames):
        for batch in frames:
            units, ranks = (batch.column(c).to_numpy() for c in ("units", "rank"))
            sequence, slot = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(units):
                rows, p = units == n, found[int(n)]
                run = np.searchsorted(p.first, ranks[rows], side="right") - 1
                inside = ranks[rows] - p.first[run]
                sequence[rows] = p.sequence[run] + inside // p.each[run]
                slot[rows] = p.slot[run] + inside % p.each[run]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(slot)], [*kept, "sequence_id", "_slot"]
            )

    kind = cut.schema[key].dataType.simpleString()
    placed = order.select(*kept, "units", "rank").mapInArrow(
        batches, f"`{key}` {kind}, " + ", ".join(f"`{n}` bigint" for n in [*kept[1:], "sequence_id", "_slot"])
    )
    before = W.partitionBy("sequence_id").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_slot")
