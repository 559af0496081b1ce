"""How far the words of each source are from those of its language, by in-mapper stripes.

Every task folds whole documents into stripes: for a language and a term, the number of
documents and the occurrences by source. A full table of stripes is sent on and a new one
begun, so memory is bounded. Stripes are dealt and sorted by language and term, and each
run of equal keys is added up in one pass, whatever the number of tasks that sent some.
Merged stripes are then dealt into blocks of a language; a block sees the totals of all
sources of its language and gives the divergences of its terms.

All arithmetic is on integers. ``p`` of a term is ``1 + floor(SCALE * (count + 1) / (N + V))``
with ``N`` occurrences and ``V`` terms kept; the divergence of ``p`` from ``q`` is
``floor((p - q) * (p - q) / q)``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tableferry.llm.common import broadcast_if_small, stored

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = str.maketrans(UPPER, LOWER)
#: Documents of a language that a kept term is in, at least, and terms that a source shows, at most.
DOCUMENTS, SHOWN = 3, 200
#: Powers of ten that shares are counted in, three at a time.
SCALE_STEPS = 3
#: Entries of the stripes that a task holds before it sends them on.
HELD = 2_000_000
#: Characters of a text that are matched at once; the cut is moved to the end of a term.
PIECE = 1 << 20
#: Characters of the texts that are counted at once.
BLOCK = 1 << 20
#: Cells (terms by sources) of a block.
CELLS = 1 << 19
#: Rows that are broadcast, at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

STRIPE = "lang string, term string, docs bigint, sources array<string>, counts array<bigint>"


def pieces(text: str) -> Iterator[list[str]]:
    """Terms of a whole text, in lists of about ``PIECE`` characters of it."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + PIECE)
        if stop < len(text) and (more := TERM.match(text, stop)):
            stop = more.end()  # no term is cut
        yield TERM.findall(text[at:stop].translate(FOLDED))
        at = stop


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, in order, with the sum of its counts."""
    found, where = np.unique(codes, return_inverse=True)
    sums = np.zeros(len(found), dtype=np.int64)
    np.add.at(sums, where, counts)
    return found, sums


class Stripes:
    """The table of stripes of one language: numbers of terms and sources, and counts by both."""

    def __init__(self) -> None:
        self.terms: defaultdict[str, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.sources: defaultdict[str, int] = defaultdict()
        self.sources.default_factory = self.sources.__len__
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.entries = 0

    def add(self, sources: list[str], lists: list[list[str]]) -> None:
        """Documents of one block, each by all of its terms."""
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        ids = np.fromiter(map(self.terms.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=int(sizes.sum()))
        source = np.fromiter(map(self.sources.__getitem__, sources), dtype=np.int64, count=len(sources))
        doc = np.repeat(np.arange(len(lists)), sizes)
        each, n = np.unique(doc << 40 | ids, return_counts=True)
        doc, ids = each >> 40, each & (1 << 40) - 1
        self._keep(ids, ids << 32 | source[doc], n)

    def add_long(self, source: str, lists: Iterator[list[str]]) -> None:
        """One document, piece by piece."""
        seen, at = [], self.sources[source]
        for terms in lists:
            ids, n = np.unique(np.fromiter(map(self.terms.__getitem__, terms), np.int64, len(terms)), return_counts=True)
            self.counts.append((ids << 32 | at, n))
            self.entries += len(ids)
            seen = [np.unique(np.concatenate([*seen, ids]))]
        none = np.zeros(0, np.int64)
        self._keep(seen[0] if seen else none, none, none)

    def _keep(self, ids: np.ndarray, codes: np.ndarray, n: np.ndarray) -> None:
        self.docs.append(_added(ids, np.ones(len(ids), dtype=np.int64)))
        self.counts.append(_added(codes, n))
        self.entries += len(self.counts[-1][0])

    def merge(self) -> None:
        for name in ("docs", "counts"):
            parts = getattr(self, name)
            if len(parts) > 1:
                setattr(self, name, [_added(*(np.concatenate(p) for p in zip(*parts, strict=True)))])
        self.entries = sum(len(c) for c, _ in self.counts)

    def sent(self, lang: str) -> Iterator[pa.RecordBatch]:
        """The stripes as rows."""
        self.merge()
        if not self.terms:
            return
        codes, counts = self.counts[0]
        docs = np.zeros(len(self.terms), dtype=np.int64)
        docs[self.docs[0][0]] = self.docs[0][1]
        ends = np.searchsorted(codes >> 32, np.arange(len(self.terms) + 1)).astype(np.int32)
        names = pa.array(list(self.sources), pa.string()).take(pa.array(codes & (1 << 32) - 1))
        yield _rows(pa.array([lang] * len(self.terms), pa.string()), pa.array(list(self.terms), pa.string()), docs, ends, names, counts)


def _rows(lang: pa.Array, terms: pa.Array, docs: np.ndarray, ends: np.ndarray, names: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array(ends), values) for values in (names, pa.array(counts))]
    return pa.RecordBatch.from_arrays([lang, terms, pa.array(docs), *lists], ["lang", "term", "docs", "sources", "counts"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of the documents of one task, in as many tables as ``HELD`` asks for."""
    held: defaultdict[str, Stripes] = defaultdict(Stripes)
    waiting: dict[str, tuple[list, list]] = {}
    size = 0

    def fold() -> None:
        for lang, (sources, lists) in waiting.items():
            held[lang].add(sources, lists)
        waiting.clear()

    for batch in batches:
        for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(text) > PIECE:
                held[lang].add_long(source, pieces(text))
                size += len(text)
            else:
                sources, lists = waiting.setdefault(lang, ([], []))
                sources.append(source)
                lists.append(next(pieces(text), []))
                size += len(text)
            if size < BLOCK:
                continue
            fold()
            size = 0
            if sum(s.entries for s in held.values()) > HELD:
                for s in held.values():
                    s.merge()
                if sum(s.entries for s in held.values()) > HELD // 2:
                    for name, s in held.items():
                        yield from s.sent(name)
                    held.clear()
    fold()
    for name, s in held.items():
        yield from s.sent(name)


def _runs(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows that are equal in language and term, and follow each other, as one."""
    lang, term = rows.column("lang"), rows.column("term")
    new = np.ones(rows.num_rows, dtype=bool)
    changed = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1]))
    new[1:] = changed.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    lists = rows.column("sources")
    names = lists.flatten().dictionary_encode()
    width = max(1, len(names.dictionary))
    row = np.repeat(np.cumsum(new) - 1, np.diff(lists.offsets.to_numpy()))
    codes, counts = _added(row * width + names.indices.to_numpy(), rows.column("counts").flatten().to_numpy())
    ends = np.searchsorted(codes // width, np.arange(len(starts) + 1)).astype(np.int32)
    at = pa.array(starts)
    docs = np.add.reduceat(rows.column("docs").to_numpy(), starts)
    return _rows(lang.take(at), term.take(at), docs, ends, names.dictionary.take(pa.array(codes % width)), counts)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes added up; rows come in the order of language and term."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch.cast(last.schema)]).combine_chunks().to_batches()[0]
        found = _runs(batch)
        if found.num_rows > 1:
            yield found.slice(0, found.num_rows - 1)
        last = _runs(found.slice(found.num_rows - 1))  # goes on, perhaps, in the next rows
    if last is not None:
        yield last


def stripes(docs: DataFrame) -> DataFrame:
    """Merged stripes of ``text``, ``lang`` and ``source``: one row for each language and term."""
    sent = docs.select("text", "lang", "source").mapInArrow(_folded, STRIPE)
    return sent.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merged, STRIPE)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """``1 + floor(10**9 * (counts + 1) / totals)``, exact for totals up to 9e15: three digits at a time."""
    rest, out = counts + 1, np.zeros(np.broadcast_shapes(counts.shape, totals.shape), dtype=np.int64)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        digit = rest // totals
        out, rest = out * 1000 + digit, rest - digit * totals
    return out + 1


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _block(found: pa.Table, totals: pa.Table) -> pa.Table:
    """Divergences of one block: partial sums of pairs, and the first ``SHOWN`` terms of each source."""
    names = totals.column("source").to_pylist()
    order = {s: i for i, s in enumerate(names)}
    n = totals.column("n").to_numpy().astype(np.int64)
    kept = int(totals.column("kept")[0].as_py())
    terms = found.column("term").to_pylist()
    lists = found.column("sources").combine_chunks()
    rows = np.repeat(np.arange(len(terms)), np.diff(lists.offsets.to_numpy()))
    columns = np.fromiter((order[s] for s in lists.flatten().to_pylist()), dtype=np.int64, count=len(rows))
    counts = np.zeros((len(terms), len(names)), dtype=np.int64)
    counts[rows, columns] = found.column("counts").combine_chunks().flatten().to_numpy()
    p = shares(counts, (n + kept)[None, :])
    q = shares(counts.sum(axis=1), n.sum() + np.full(len(terms), kept))
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}

    def add(source: str, part: str, items: list, values: np.ndarray) -> None:
        out["source"] += [source] * len(items)
        out["part"] += [part] * len(items)
        out["item"] += items
        out["value"].append(values)

    utf8 = np.array([t.encode("utf-8", "surrogatepass") for t in terms], dtype=object)
    place = np.empty(len(terms), dtype=np.int64)
    place[np.argsort(utf8, kind="stable")] = np.arange(len(terms))
    for i, source in enumerate(names):
        sums = _divergence(p[:, i : i + 1], p).sum(axis=0)
        others = np.flatnonzero(np.arange(len(names)) != i)
        add(source, "pair", [names[j] for j in others], sums[others])
        above = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q))
        values = _divergence(p[above, i], q[above])
        first = np.lexsort((place[above], -values))[:SHOWN]
        add(source, "term", [terms[k] for k in above[first]], values[first])
    lang = [totals.column("lang")[0].as_py()] * len(out["source"])
    columns = [pa.array(lang, pa.string()), *(pa.array(out[c], pa.string()) for c in ("source", "part", "item"))]
    values = np.concatenate(out["value"]) if out["value"] else np.zeros(0, np.int64)
    return pa.Table.from_arrays([*columns, pa.array(values, pa.int64())], ["lang", "source", "part", "item", "value"])


def _cogrouped(key, found: pa.Table, totals: pa.Table) -> pa.Table:
    return _block(found, totals)


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias(name)


def audit(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` of every source.

    Part ``pair``: the divergence of the source from each other source of its language, as
    a sum over all kept terms. Part ``term``: kept terms that are commoner in the source
    than in its language, the first ``SHOWN`` by value and then by UTF-8. NULLs count as
    empty text; a group without terms has its pairs; a language with one source has no
    pairs; repeated rows are documents of their own; an empty table gives no rows; other
    columns are not read.
    """
    docs = docs.select(_text("text"), _text("lang"), _text("source"))
    groups = stored(docs.select("lang", "source").distinct(), "sources")
    kept = stored(stripes(docs).where(F.col("docs") >= DOCUMENTS), "stripes")

    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    counted = (
        kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("_e"))
        .groupBy("lang", F.col("_e.sources").alias("source"))
        .agg(F.sum("_e.counts").alias("n"))
    )
    totals = stored(
        groups.join(counted, ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept")),
        "totals",
    )
    # blocks of a language, so that terms by sources stay within CELLS
    width = totals.groupBy("lang").agg(
        F.greatest(F.lit(1), F.ceil(F.max("kept") * F.count(F.lit(1)) / CELLS)).cast("long").alias("blocks")
    )
    width = stored(width, "widths")
    small = broadcast_if_small(width, width.count(), BROADCAST_ROWS)
    dealt = kept.join(small, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "term", "sources", "counts"
    )
    seen = totals.join(small, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "n", "kept"
    )
    parts = stored(
        dealt.groupBy("lang", "block")
        .cogroup(seen.groupBy("lang", "block"))
        .applyInArrow(_cogrouped, "lang string, source string, part string, item string, value bigint"),
        "parts",
    )
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    shown = parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= SHOWN)
    return pairs.withColumn("rank", rank).unionByName(shown)
