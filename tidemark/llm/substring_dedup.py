"""Substring dedup with repeated-phrase automata.

A passage recurs if one of its windows of ``WINDOW`` consecutive words also
starts in a document with a smaller id.  Documents are dealt into chunks by
ranges of their id, bounded in bytes.

1. A chunk posts the sorted hashes of its distinct windows, split by hash range,
   to the task that confirms recurrence over all chunks.  A window that stands in
   any number of documents counts once per chunk, so no key is hot.
2. For every window that stands in more than one chunk that task names a chunk
   that provides its text and the later chunks to provide it to, ``FAN`` of them
   at most; further ones get it from the ``FAN``-th, and so on, as in a tree.
3. A providing chunk cuts the confirmed passages from its documents, as maximal
   runs of windows for each chunk to provide them to, with the smallest id that
   has them.
4. Each chunk compiles the passages that it got, and those that recur between its
   own documents, into Aho-Corasick automata over word codes, ``SHARD_PHRASES``
   phrases in each, and streams all its documents through them.  A passage's
   phrases are ``PHRASE`` words long and ``STRIDE`` words apart, so every window
   of it contains exactly one.  Around each place that the automata come upon,
   the windows that hold the phrase are compared with the passage, word by word;
   those that are equal and come from a smaller id are removed.

Hashes only let texts meet; what is removed has been found by an automaton and
compared in full.  Two windows with one 64-bit hash could hide a passage: with n
windows in all the chance of that is about n * n / 2**65.

Defined results: a null text is empty; a document of fewer words than a window
loses nothing; rows that repeat an id are one document for the comparison (none
of them comes before the other) and each has its own result row; a null id comes
after all others and equals other null ids; an id with more text than a chunk is
split by hash of the text; an empty table gives an empty result.  Only id and
text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import bound_batches, read_table
from .textblock import TextBlock, U, blocks, bytes_of

WINDOW, PHRASE = 13, 5
STRIDE = WINDOW - PHRASE + 1
CHUNK_BYTES, MIN_CHUNKS = 4 << 20, 32
#: Bytes of text whose windows one confirming task compares; and partitions at most, which then hold several chunks each.
CONFIRM_BYTES, MAX_PARTITIONS = 24 << 20, 20_000
FAN = 64
SHARD_PHRASES = 30_000
_LAST = np.iinfo(np.int64).max
#: A word's code has three letters: the first from one alphabet, so that a match begins at a word, the others from another.
#: Small alphabets, because the automaton searches a node's letters one after another.
LETTERS = 128


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as their differences, in as few whole bytes as the largest takes; bytes of one place stand together, since the high ones compress."""
    diff = values.copy()
    diff[1:] -= values[:-1]
    width = max(1, (int(diff.max()).bit_length() + 7) // 8) if len(diff) else 1
    return bytes([width]) + np.ascontiguousarray(diff.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return np.cumsum(out.view("<u8").reshape(-1), dtype=U)


def _post(bits: int):
    """Step 1: (bucket, chunk, hashes) of every chunk in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for rows, t in blocks(batches, "text"):
            chunk = np.asarray(rows.column(0))
            hashes, at = t.windows(WINDOW, t.word_hashes())
            of = chunk[np.searchsorted(t.woff, at, "right") - 1]
            for c in np.unique(chunk).tolist():
                own = hashes if (chunk == c).all() else hashes[of == c]
                found.setdefault(c, []).append(np.unique(own))
        for c in sorted(found):
            values = np.unique(np.concatenate(found.pop(c)))
            bucket = (values >> U(64 - bits)).astype(np.int32) if bits else np.zeros(len(values), np.int32)
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(at[1:], len(values))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(np.full(len(at), c, np.int32)), pa.array([pack(values[a:b]) for a, b in zip(at, ends)], pa.binary())], ["bucket", "chunk", "hashes"])

    return run


def _confirm(levels: np.ndarray):
    """Step 2, for one hash range: which windows each chunk provides to which others.

    ``levels``: of each chunk, the number of its id range; chunks of one level
    share an id that is too large for one chunk.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        chunks = np.array(table["chunk"].combine_chunks())
        lists = [unpack(x.as_py()) for x in table["hashes"]]
        sizes = np.array([len(x) for x in lists])
        values = np.concatenate(lists)
        del lists
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        del values, ranked
        size = np.diff(np.append(first, len(order)))
        again = np.flatnonzero(size > 1)
        begin, more = first[again], size[again] - 1
        place = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)  # 0 for the second chunk that has it
        begin = np.repeat(begin, more)
        offs = np.concatenate([[0], np.cumsum(sizes)])
        of = lambda at: np.searchsorted(offs, at, "right") - 1
        to = of(order[begin + place + 1])
        giver = order[begin + place // FAN * FAN]
        late = levels[chunks[of(giver)]] >= levels[chunks[to]]  # a provider must have smaller ids only
        giver[late] = order[begin[late]]
        who = of(giver)
        by = np.lexsort((giver, to, who))
        who, to, which = who[by], to[by], (giver - offs[who])[by] if len(by) else giver
        cut = np.flatnonzero(np.diff(who, prepend=-1))
        ends = np.append(cut[1:], len(who))
        rows = [(int(chunks[who[a]]), which[a:b].astype("<i4").tobytes(), chunks[to[a:b]].astype("<i4").tobytes()) for a, b in zip(cut.tolist(), ends.tolist())]
        cols = list(zip(*rows)) or [(), (), ()]
        bucket = table["bucket"][0].as_py()
        return pa.table({"chunk": pa.array(cols[0], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "which": pa.array(cols[1], pa.binary()), "to": pa.array(cols[2], pa.binary())})

    return run


class _Chunk:
    """The documents of one chunk by id: word hashes, the start of every window, its hash."""

    def __init__(self, docs: pa.Table):
        ids = np.array(docs["doc_id"].combine_chunks().fill_null(_LAST))
        order = np.argsort(ids, kind="stable")
        self.docs, self.ids = docs.take(pa.array(order)), ids[order]
        hashes, sizes, self.texts, spans = [], [], [], []
        for rows, t in blocks(iter(self.docs.combine_chunks().to_batches()), "text"):
            hashes.append(t.word_hashes())
            sizes.append(t.n_words)
            self.texts.append(rows.column(rows.schema.get_field_index("text")))
            spans.append((t.buf, t.starts, t.ends))
        self.spans = spans
        self.words = np.concatenate([np.zeros(0, U), *hashes])
        self.offs = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int64)
        self.at = TextBlock.window_starts(None, WINDOW, self.offs)
        self.window = TextBlock.run_hash(self.words, self.at, self.at + WINDOW)
        self.own = self.ids[np.searchsorted(self.offs, self.at, "right") - 1]  # the id of each window's document

    def bytes_between(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The text from word ``first`` to word ``last``, which are of one document."""
        bounds = np.cumsum([0, *(len(starts) for _, starts, _ in self.spans)])
        out = []
        for a, b, part in zip(first.tolist(), last.tolist(), (np.searchsorted(bounds, first, "right") - 1).tolist()):
            buf, starts, ends = self.spans[part]
            out.append(buf[starts[a - bounds[part]] : ends[b - bounds[part]]].tobytes())
        return out


def _runs(start: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of window starts in order: the index of the first and of the last of every run of consecutive ones."""
    new = np.diff(start, prepend=-9) != 1
    if group is not None:
        new |= np.diff(group, prepend=-9) != 0
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(start)) - 1 if len(first) else first


def _provide(bits: int):
    """Step 3, for one chunk: the passages for every chunk that it provides."""

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if answers.num_rows and docs.num_rows:
            c = _Chunk(docs)
            kinds, first = np.unique(c.window, return_index=True)
            lead = (kinds >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(kinds), np.int64)
            begin = np.searchsorted(lead, np.array(answers["bucket"].combine_chunks()))
            which = np.concatenate([np.frombuffer(x.as_py(), "<i4") + b for x, b in zip(answers["which"], begin)])
            to = np.concatenate([np.frombuffer(x.as_py(), "<i4") for x in answers["to"]])
            place = first[which]
            order = np.lexsort((place, to))
            place, to = place[order], to[order]
            lo, hi = _runs(c.at[place], to)
            texts, ids, to = c.bytes_between(c.at[place[lo]], c.at[place[hi]] + WINDOW - 1), c.own[place[lo]].tolist(), to[lo]
            cut = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
            rows = [(int(to[a]), ids[a:b], texts[a:b]) for a, b in zip(cut, [*cut[1:], len(to)])]
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.table({"chunk": pa.array(cols[0], pa.int32()), "ids": pa.array(cols[1], pa.list_(pa.int64())), "texts": pa.array(cols[2], pa.list_(pa.binary()))})

    return run


class Passages:
    """Confirmed passages: the codes of their words end to end, their offsets, and the smallest id that has each."""

    def __init__(self, codes: np.ndarray, words: np.ndarray, offs: np.ndarray, ids: np.ndarray):
        self.codes, self.offs = codes, offs
        at = TextBlock.window_starts(None, WINDOW, offs)
        window, own = TextBlock.run_hash(words, at, at + WINDOW), ids[np.searchsorted(offs, at, "right") - 1]
        order = np.lexsort((own, window))
        window = window[order]
        first = np.concatenate([[True], window[1:] != window[:-1]]) if len(order) else np.zeros(0, bool)
        #: the distinct windows by hash: where one stands, and the smallest id
        self.window, self.at, self.own = window[first], at[order][first], own[order][first]

    def phrases(self) -> np.ndarray:
        """The first words of phrases such that every window holds exactly one."""
        size = (np.diff(self.offs) - PHRASE) // STRIDE + 1
        return np.repeat(self.offs[:-1], size) + STRIDE * (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))


def _letters(codes: np.ndarray) -> str:
    out = np.empty((len(codes), 3), "<u2")
    out[:, 0], out[:, 1], out[:, 2] = 0x100 + codes // LETTERS**2 % LETTERS, 0x200 + codes // LETTERS % LETTERS, 0x200 + codes % LETTERS
    return out.tobytes().decode("utf-16-le")


def locate(codes: np.ndarray, offs: np.ndarray, passages: Passages) -> np.ndarray:
    """The words at which a phrase of the passages begins, by streaming every document through all automata."""
    import ahocorasick

    text, bounds = _letters(codes), (3 * offs).tolist()
    known = _letters(passages.codes)
    phrases = list({known[3 * a : 3 * (a + PHRASE)] for a in passages.phrases().tolist()})
    places: list[int] = []
    for lo in range(0, len(phrases), SHARD_PHRASES):
        machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in phrases[lo : lo + SHARD_PHRASES]:
            machine.add_word(p)
        machine.make_automaton()
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= 3 * WINDOW:
                places += [a + end for end, _ in machine.iter(text[a:b])]
    return np.unique(np.array(places, np.int64) // 3 - PHRASE + 1)


def compare(chunk: _Chunk, codes: np.ndarray, passages: Passages, places: np.ndarray) -> np.ndarray:
    """The starts of the windows around located phrases that equal a passage's window, of a smaller id, in every word."""
    near = np.unique((places[:, None] - np.arange(STRIDE)).reshape(-1))
    index = np.searchsorted(chunk.at, near)
    index = index[(index < len(chunk.at))]
    index = np.unique(index[np.isin(chunk.at[index], near)]) if len(index) else index
    if not len(index) or not len(passages.window):
        return np.zeros(0, np.int64)
    found = np.minimum(np.searchsorted(passages.window, chunk.window[index]), len(passages.window) - 1)
    good = (passages.window[found] == chunk.window[index]) & (passages.own[found] < chunk.own[index])
    index, found = index[good], found[good]
    out = []
    for lo in range(0, len(index), 1 << 16):
        a, b = chunk.at[index[lo : lo + (1 << 16)]], passages.at[found[lo : lo + (1 << 16)]]
        same = np.ones(len(a), bool)
        for j in range(WINDOW):
            same &= codes[a + j] == passages.codes[b + j]
        out.append(a[same])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _passages(c: _Chunk, codes: np.ndarray, vocabulary: dict[bytes, int], given: pa.Table) -> Passages:
    """The passages that other chunks provided, and those that recur between the chunk's own documents."""
    kinds, first, kind = np.unique(c.window, return_index=True, return_inverse=True)
    start = np.sort(c.at[first[np.unique(kind[c.own > c.own[first][kind]])]])
    lo, hi = _runs(start)
    a, b = start[lo], start[hi] + WINDOW
    pick = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]) if len(a) else a, b - a) + np.arange(int((b - a).sum()))
    all_codes, all_words, sizes, ids = [codes[pick]], [c.words[pick]], [b - a], [c.ids[np.searchsorted(c.offs, a, "right") - 1]]
    for row_ids, row_texts in zip(given["ids"].to_pylist(), given["texts"].to_pylist()):
        buf, offs = bytes_of(pa.array(row_texts, pa.binary()))
        t = TextBlock(buf, offs)
        all_codes.append(np.array([vocabulary.get(w, -1) for x in row_texts for w in x.split()], np.int64))
        all_words.append(t.word_hashes())
        sizes.append(t.n_words)
        ids.append(np.array(row_ids, np.int64))
    return Passages(np.concatenate(all_codes), np.concatenate(all_words), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64), np.concatenate(ids))


def _remove(key: tuple, docs: pa.Table, given: pa.Table) -> pa.Table:
    """Step 4, for one chunk."""
    c = _Chunk(docs)
    vocabulary: dict[bytes, int] = {}
    raws = []
    for part in c.texts:
        buf, where = bytes_of(part)
        raw, where = buf.tobytes(), where.tolist()
        raws += [raw[a:b] for a, b in zip(where, where[1:])]
    # a word's code is the place where it stands first
    codes = np.fromiter(map(vocabulary.setdefault, chain.from_iterable(raw.split() for raw in raws), count()), np.int64, int(c.offs[-1]))
    removed = np.zeros(len(codes), bool)
    passages = _passages(c, codes, vocabulary, given)
    if len(passages.window):
        hit = compare(c, codes, passages, locate(codes, c.offs, passages))
        cover = np.zeros(len(codes) + 1, np.int32)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
        removed = np.cumsum(cover[:-1]) > 0
    kept, n_removed = [], []
    for d, raw in enumerate(raws):
        gone = removed[c.offs[d] : c.offs[d + 1]]
        n_removed.append(int(gone.sum()))
        own = raw.split()
        kept.append(b" ".join(compress(own, (~gone).tolist()) if n_removed[-1] else own))
    return pa.table({"doc_id": c.docs["doc_id"], "n_words": pa.array(np.diff(c.offs)), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def _digest(key: tuple, docs: pa.Table, given: pa.Table) -> pa.Table:
    found = _remove(key, docs, given)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in found["kept"].to_pylist()]
    return found.drop_columns(["kept"]).append_column("kept_sha256", pa.array(sha, pa.string()))


def id_ranges(rows: DataFrame, chunk_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """The last id of each range of about ``chunk_bytes`` of text, and how many chunks the range takes (more than one for an id that is larger).

    Ids with their sizes, summed up, are sorted by range partitions; a row comes
    to the driver for each chunk.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = 0, None
        for batch in batches:
            out = []
            for i, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, last = held + n, i
                if held >= chunk_bytes:
                    out.append((i, (held + chunk_bytes // 2) // chunk_bytes))
                    held, last = 0, None
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], ["id", "n"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([1], pa.int64())], ["id", "n"])

    sized = rows.groupBy(_known().alias("id")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("n"))
    found = sorted(tuple(r) for r in sized.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(cut, "id long, n long").collect())
    return np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64)


def _known():
    return F.coalesce(F.col("doc_id"), F.lit(int(_LAST)))


def _chunked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray, int]:
    """chunk, doc_id, text, dealt out by chunk; the range number of each chunk; and how many bits of a hash tell its range."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bounds, n = id_ranges(rows, min(CHUNK_BYTES, max(1, size // MIN_CHUNKS)))
    begin = np.concatenate([[0], np.cumsum(n)])

    @F.pandas_udf(T.IntegerType())
    def chunk_of(ids, salt):  # noqa: ANN001, ANN202
        import pandas as pd

        v = ids.to_numpy(np.int64)
        at = np.searchsorted(bounds, v, side="left")
        # an id that fills several chunks is dealt over them; the range's other ids go to the first
        return pd.Series((begin[at] + np.where(v == bounds[at], salt.to_numpy(np.int64) % n[at], 0)).astype(np.int32))

    chunk = chunk_of(_known(), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)))
    parts = int(min(max(begin[-1], MIN_CHUNKS), MAX_PARTITIONS))
    buckets = max(MIN_CHUNKS, -(-size // CONFIRM_BYTES))
    return rows.select(chunk.alias("chunk"), "doc_id", "text").repartition(parts, "chunk"), np.repeat(np.arange(len(n)), n), (buckets - 1).bit_length()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words with single spaces; with ``digest`` its SHA-256)."""
    bound_batches(docs.sparkSession)
    chunks, levels, bits = _chunked(docs, id_col, text_col)
    posted = chunks.mapInArrow(_post(bits), "bucket int, chunk int, hashes binary")
    answers = posted.groupBy("bucket").applyInArrow(_confirm(levels), "chunk int, bucket int, which binary, to binary")
    given = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_provide(bits), "chunk int, ids array<long>, texts array<binary>")
    kept = "kept_sha256" if digest else "kept"
    return chunks.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(_digest if digest else _remove, f"doc_id long, n_words long, n_removed long, {kept} string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), digest=True)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
r AS (
  SELECT DISTINCT doc_id, i + j AS i
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS lowest FROM w), (SELECT unnest(range({WINDOW})) AS j)
  WHERE lowest < doc_id),
p AS (SELECT doc_id, word, i FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d)),
k AS (
  SELECT p.doc_id, count(r.i) AS n_removed, string_agg(CASE WHEN r.i IS NULL THEN word END, ' ' ORDER BY p.i) AS kept
  FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.i = r.i GROUP BY p.doc_id)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
