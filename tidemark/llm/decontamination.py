"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle sets.  For the items of one
partition every document is cut into overlapping stretches a little longer than
the items, so that a whole item lies in one stretch however long the document
is, and a stretch is a candidate for an item if their MinHash signatures agree
in a coordinate.  Candidates are verified with exact set containment of the
item's shingles in the whole document.

A coordinate agrees only where the item's minimal shingle stands in the
stretch; stretches without any item shingle are therefore not signed.

What an item's parts leave scattered over a document shows in no one stretch.
So a document is a candidate also if, for ``SCATTERED`` of the coordinates, the
shingle that is the item's minimum stands anywhere in it: the share of those
coordinates estimates the containment itself.  At a containment of 0.75 the
chance to miss is 1e-17, for items of few shingles less than 1e-10.

Items of up to ``DIRECT_SHINGLES`` shingles are not signed: every document with
one of their shingles is a candidate.

The documents are read once for any number of items: items come in blocks of
bounded size, broadcast one by one, and every Arrow batch of documents is held
against each block; blocks that are large together are loaded one at a time.

Shingles are runs of five words, A-Z folded.  Defined results: an item of fewer
words is one shingle, its whole sequence; an item without words is in no
document; a null text is empty; repeated rows of either table are matched row
by row; null ids are carried as null; an empty table of either kind gives no
pairs, and decontamination then keeps every document.  Other columns are
carried or ignored by position, so their names don't matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import bound_batches, read_table
from .textblock import TextBlock, U, blocks, bytes_of, repeated, stream

SHINGLE = 5
MIN_CONTAINMENT_PERCENT = 75
COORDINATES = 64
#: Items of so few shingles are looked up by each of them.
DIRECT_SHINGLES = 3
#: Of the coordinates, so many minima of an item make a document a candidate wherever they stand.
SCATTERED = 16
#: Items are searched in blocks of so many, or of so many bytes: what a task holds has this bound for any size of the item table.
ITEMS_PER_BLOCK, BLOCK_BYTES = 20_000, 8 << 20
#: Blocks of no more bytes than this together stay loaded.
HELD_BYTES = 128 << 20

_FLIP, _SCALE = stream(COORDINATES, 101), stream(COORDINATES, 202) | U(1)


class ItemIndex:
    """Signatures of one block of items, by size partition, and their exact shingle sets."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        buf, offs = bytes_of(pa.array(texts, pa.string()))
        t = TextBlock(buf, offs)
        words = t.word_hashes(fold=True)
        self.shingles: dict[int, list[tuple[int, np.ndarray]]] = {}  # by words in a shingle: item and its sorted set
        for d in range(t.n):
            own = words[t.woff[d] : t.woff[d + 1]]
            if not len(own):
                continue
            k = min(SHINGLE, len(own))
            at = np.arange(len(own) - k + 1)
            self.shingles.setdefault(k, []).append((d, np.unique(TextBlock.run_hash(own, at, at + k))))
        self.known, self.parts, self.exact = {}, {}, {}
        direct: dict[int, list[tuple[int, int]]] = {}  # by words in a shingle: shingle and item
        minima: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}  # by words in a shingle: minimal shingles, of how many coordinates, item
        for k, items in self.shingles.items():
            self.known[k] = np.unique(np.concatenate([s for _, s in items]))
            for d, s in items:
                self.exact[d] = s
                if len(s) <= DIRECT_SHINGLES:
                    direct.setdefault(k, []).extend((g, d) for g in s.tolist())
                    continue
                low, n = np.unique(s[((s[None, :] ^ _FLIP[:, None]) * _SCALE[:, None]).argmin(1)], return_counts=True)
                minima.setdefault(k, []).append((low, n, d))
                size = _partition(len(s))
                self.parts.setdefault((k, size), []).append((d, _signature(s[:, None])[0]))
        self.direct = {k: (np.array([g for g, _ in rows], U), np.array([d for _, d in rows])) for k, rows in ((k, sorted(rows)) for k, rows in direct.items())}
        self.minima = {}
        for k, rows in minima.items():
            low, n = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            order = np.argsort(low, kind="stable")
            self.minima[k] = (low[order], n[order], np.repeat([r[2] for r in rows], [len(r[0]) for r in rows])[order])
        self.tables = {}
        for key, rows in self.parts.items():
            sig = np.stack([s for _, s in rows])
            order = np.argsort(sig, axis=0, kind="stable")
            self.tables[key] = (np.take_along_axis(sig, order, 0), np.array([d for d, _ in rows])[order])


def _partition(n: int) -> int:
    """The least of 8, 12, 16, 24, 32, 48 ... that is n or more."""
    size = 8
    while size < n:
        size = size * 3 // 2 if size & (size - 1) == 0 else size * 4 // 3
    return size


def _signature(values: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """MinHash coordinates of runs of shingle hashes that begin at ``starts``; one run by default."""
    starts = np.zeros(1, np.int64) if starts is None else starts
    flat = values.reshape(-1)
    out = np.empty((len(starts), COORDINATES), U)
    for i in range(COORDINATES):
        out[:, i] = np.minimum.reduceat((flat ^ _FLIP[i]) * _SCALE[i], starts)
    return out


def _candidates(index: ItemIndex, k: int, size: int, hashes: np.ndarray, hit: np.ndarray, text_of: np.ndarray, first: np.ndarray, last: np.ndarray) -> set[tuple[int, int]]:
    """(text, item) pairs of one partition.  hit: places of item shingles; first, last: of each text's shingles."""
    half = max(1, size // 2)
    d = text_of[hit]
    block = (hit - first[d]) // half
    keys = np.unique(np.concatenate([(d << 40) + np.maximum(block - j, 0) for j in range(3)]))
    d, begin = keys >> 40, keys & ((1 << 40) - 1)
    begin = first[d] + begin * half
    length = np.minimum(begin + 3 * half, last[d]) - begin
    starts = np.cumsum(length) - length
    at = np.repeat(begin - starts, length) + np.arange(int(length.sum()))
    values, items = index.tables[k, size]
    found = set()
    for lo in range(0, len(starts), 4096):
        hi = min(lo + 4096, len(starts))
        a, b = starts[lo], starts[hi - 1] + length[hi - 1]
        sig = _signature(hashes[at[a:b]], starts[lo:hi] - a)
        for i in range(COORDINATES):
            left = np.searchsorted(values[:, i], sig[:, i], "left")
            right = np.searchsorted(values[:, i], sig[:, i], "right")
            for w in np.flatnonzero(right > left):
                found.update((int(d[lo + w]), int(x)) for x in items[left[w] : right[w], i])
    return found


def _scattered(index: ItemIndex, k: int, own: np.ndarray, text: np.ndarray) -> set[tuple[int, int]]:
    """(text, item) pairs of which ``SCATTERED`` coordinates' minimal shingles stand in the text; own, text: each text's distinct item shingles."""
    low, n, items = index.minima[k]
    left, right = np.searchsorted(low, own, "left"), np.searchsorted(low, own, "right")
    size = right - left
    at = np.repeat(left - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    keys, inverse = np.unique((np.repeat(text, size) << 32) + items[at], return_inverse=True)
    keys = keys[np.bincount(inverse, n[at], len(keys)) >= SCATTERED]
    return set(zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist()))


def _contained(index: ItemIndex, t: TextBlock) -> list[tuple[int, int, int, int]]:
    """(text, item, shared, size) of the verified pairs of a block."""
    words = t.word_hashes(fold=True)
    out = []
    for k, known in index.known.items():
        hashes, at = t.windows(k, words)
        if not len(hashes):
            continue
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = np.flatnonzero(known[place] == hashes)
        if not len(hit):
            continue
        bounds = np.searchsorted(at, t.woff)
        text_of = np.repeat(np.arange(t.n), np.diff(bounds))
        pairs: set[tuple[int, int]] = set()
        for part in index.tables:
            if part[0] == k:
                pairs |= _candidates(index, k, part[1], hashes, hit, text_of, bounds[:-1], bounds[1:])
        if k in index.minima:
            _, first = repeated(hashes[hit], text_of[hit])
            pairs |= _scattered(index, k, hashes[hit][first], text_of[hit][first])
        if k in index.direct:
            values, items = index.direct[k]
            left, right = np.searchsorted(values, hashes[hit], "left"), np.searchsorted(values, hashes[hit], "right")
            for w in np.flatnonzero(right > left):
                pairs.update((int(text_of[hit[w]]), int(x)) for x in items[left[w] : right[w]])
        sets: dict[int, np.ndarray] = {}
        for d, item in sorted(pairs):
            if d not in sets:
                own = hit[(hit >= bounds[d]) & (hit < bounds[d + 1])]
                sets[d] = np.unique(hashes[own])
            exact = index.exact[item]
            shared = int(np.isin(exact, sets[d], assume_unique=True).sum())
            if 100 * shared >= MIN_CONTAINMENT_PERCENT * len(exact):
                out.append((d, item, shared, len(exact)))
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[ItemIndex]:
    """Indexes of blocks of items; the driver holds one block at a time."""
    rows, ids, texts, size = items.select(F.col(id_col).cast("long"), F.col(text_col)), [], [], 0
    for row in rows.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "")
        if len(ids) == ITEMS_PER_BLOCK or size >= BLOCK_BYTES:
            yield ItemIndex(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield ItemIndex(ids, texts)


def _searcher(spark: SparkSession, items: DataFrame, id_col: str, text_col: str):
    """A function for workers: (row, item id, shared, size) of every verified pair of a batch and any of the items."""
    parts, total = [], 0
    for index in item_blocks(items, id_col, text_col):
        data = cloudpickle.dumps(index)
        total += len(data)
        parts.append(spark.sparkContext.broadcast(data))
    hold, held = total <= HELD_BYTES, []

    def search(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int | None, int, int]]:
        if hold and not held:
            held.extend(pickle.loads(p.value) for p in parts)
        for index in held if hold else (pickle.loads(p.value) for p in parts):
            at = 0
            for rows, t in blocks(iter([batch]), text):
                for d, item, shared, size in _contained(index, t):
                    yield at + d, index.ids[item], shared, size
                at += rows.num_rows

    return search


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item of which it contains 75 % or more: doc_id, item_id, n_shared, n_item."""
    bound_batches(docs.sparkSession)
    search = _searcher(docs.sparkSession, items, item_id_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(search(batch, "text"))
            if found:
                d, *rest = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "item_id", "n_shared", "n_item"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, item_id long, n_shared long, n_item long")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that contain an item; no column is added and nothing is shuffled."""
    bound_batches(docs.sparkSession)
    search = _searcher(docs.sparkSession, items, item_id_col, item_text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[d for d, *_ in search(batch, text_col)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _shingles(table: str, key: str) -> str:
    """SQL for the shingles of each row of a table with id and text."""
    return rf"""
  SELECT {key}, array_to_string(w[i:i + least({SHINGLE}, len(w)) - 1], ' ') AS g, least({SHINGLE}, len(w)) AS k
  FROM (SELECT {key}, w, unnest(range(1, len(w) - least({SHINGLE}, len(w)) + 2)) AS i
        FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table})
        WHERE len(w) > 0)"""


ORACLE_SQL = f"""
WITH b AS (SELECT DISTINCT item_id, g FROM ({_shingles("benchmark", "item_id")})),
d AS (SELECT DISTINCT doc_id, g FROM ({_shingles("documents", "doc_id")})),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item FROM s JOIN n USING (item_id) WHERE 100 * n_shared >= {MIN_CONTAINMENT_PERCENT} * n_item
"""
