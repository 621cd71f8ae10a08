"""Byte-level BPE encoding and decoding by tree concatenation.

A long text is halved until its leaves are short; the leaves are encoded
independently of one another, ``THREADS`` at a time (the encoder releases the
interpreter's lock); then neighbours are joined upwards, the joins of one level
side by side too.  At a join a
window of tokens around the seam is encoded again, and the window grows until
its first tokens equal the left side's and its last ones equal the right
side's.  A sequence of BPE tokens is the encoding of its text if every two
neighbours in it are the encoding of theirs; with tokens in common at both ends
of the window, all neighbours of the joined sequence come from an encoding.

Defined results: a null text is encoded as an empty one, without tokens; rows
with a repeated id are encoded row by row; null ids are carried; an empty table
gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import bound_batches, read_table
from .textblock import Memo, TextBlock, blocks

LEAF_BYTES = 8192
THREADS = 4
FIRST_WINDOW, AGREE = 16, 4
BLOCK = 1 << 18

# Fixed value: the pre-tokeniser's pattern of byte-level BPE, as the library has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary from the JSON file of the tokenizers library."""

    def __init__(self, text: str):
        import tiktoken

        spec = json.loads(text)
        model, letters = spec["model"], byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        ranks, ids = {}, []
        added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        for token in [*letters, *("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])]:
            if token in raw and raw[token] not in ranks:
                ranks[raw[token]] = len(ids)
                ids.append(model["vocab"][token])
        self.ids = np.array(ids, np.int32)
        self.fast = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = tuple(added)
        self._text, self._whole = text, None
        content = {i: raw[t] for t, i in model["vocab"].items() if t in raw} | {i: t.encode() for t, i in added.items()}
        n = max(content) + 1
        self.token_bytes = _table([content.get(i, b"") for i in range(n)])
        self.decimal = _table([b"%d," % i for i in range(n)])

    def encode(self, text: str) -> np.ndarray:
        """The library's ids of a text, directly."""
        if any(a in text for a in self.added):
            if self._whole is None:
                from tokenizers import Tokenizer

                self._whole = Tokenizer.from_str(self._text)
                self._whole.no_truncation()
                self._whole.no_padding()
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.int32)
        return self.ids[self.fast.encode_to_numpy(text, disallowed_special=())]


def _table(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def gather(values: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``values`` end to end, and the offsets of each in the result."""
    size = offs[rows + 1] - offs[rows]
    out = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(offs[rows] - out[:-1], size) + np.arange(out[-1])], out


def leaf_offsets(buf: np.ndarray, offs: np.ndarray, most: int = LEAF_BYTES) -> np.ndarray:
    """The offsets with the midpoints of longer texts added, and of their halves, on character boundaries."""
    cuts = []
    todo = [(int(a), int(b)) for a, b in zip(offs, offs[1:]) if b - a > most]
    while todo:
        a, b = todo.pop()
        mid = (a + b) // 2
        while mid > a and (buf[mid] & 0xC0) == 0x80:
            mid -= 1
        if mid == a:
            continue
        cuts.append(mid)
        todo += [(x, y) for x, y in ((a, mid), (mid, b)) if y - x > most]
    return np.sort(np.concatenate([offs, np.array(cuts, np.int64)])) if cuts else offs


def join(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids of two neighbouring texts together."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    data, offs = v.token_bytes
    w = FIRST_WINDOW
    while True:
        a, b = max(0, len(left) - w), min(len(right), w)
        while a and (data[offs[left[a]]] & 0xC0) == 0x80:
            a -= 1
        while b < len(right) and (data[offs[right[b]]] & 0xC0) == 0x80:
            b += 1
        old = np.concatenate([left[a:], right[:b]])
        new = v.encode(gather(data, offs, old)[0].tobytes().decode("utf-8", "replace"))
        if (a == 0 or np.array_equal(new[:AGREE], left[a : a + AGREE])) and (b == len(right) or np.array_equal(new[-AGREE:], right[b - AGREE : b])):
            return np.concatenate([left[:a], new, right[b:]])
        w *= 2


def join_all(v: Vocabulary, parts: list[np.ndarray], run=map) -> np.ndarray:
    """The ids of neighbouring texts together; ``run`` maps the joins of one level."""
    while len(parts) > 1:
        joined = list(run(lambda pair: join(v, *pair), zip(parts[::2], parts[1::2])))
        parts = joined + parts[len(parts) & ~1 :]
    return parts[0]


def encode_block(v: Vocabulary, t: TextBlock, threads: int = THREADS) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts of a block end to end, and their offsets; ``threads`` leaves of long texts at a time."""
    leaves = leaf_offsets(t.buf, t.offs)
    data = t.buf.tobytes()
    texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(leaves.tolist(), leaves[1:].tolist())]
    if len(leaves) == len(t.offs):
        coded = [v.encode(x) for x in texts]
    else:
        of = np.searchsorted(t.offs, leaves[:-1], "right") - 1
        split = np.bincount(of, minlength=t.n) > 1
        with ThreadPoolExecutor(threads) as pool:
            run = pool.map if threads > 1 else map
            long = iter(list(run(v.encode, [x for x, d in zip(texts, of.tolist()) if split[d]])))
            parts: list[list[np.ndarray]] = [[] for _ in range(t.n)]
            for x, d in zip(texts, of.tolist()):
                parts[d].append(next(long) if split[d] else v.encode(x))
            coded = [join_all(v, x, run) if x else np.zeros(0, np.int32) for x in parts]
    return np.concatenate([np.zeros(0, np.int32), *coded]), np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)


def decode_block(v: Vocabulary, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """The decoded text of each stretch of ids, in UTF-8."""
    data, at = gather(*v.token_bytes, ids)
    raw, at = data.tobytes(), at[offs].tolist()
    return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(at, at[1:])]


_vocabularies: dict[int, Vocabulary] = Memo()


def vocabulary(text: str) -> Vocabulary:
    """One for each worker and file."""
    key = hash(text)
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(text)
    return _vocabularies[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _spec(spark: SparkSession, path: str | None):
    """The vocabulary file as a broadcast; it is a few MB whatever the input."""
    with open(path or default_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", threads: int = THREADS) -> DataFrame:
    """doc_id and ids (array<int>) of every document.  path: the vocabulary's JSON file, on the driver."""
    bound_batches(docs.sparkSession)
    spec = _spec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(spec.value)
        for rows, t in blocks(batches, "text", BLOCK):
            ids, offs = encode_block(v, t, threads)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", threads: int = THREADS) -> DataFrame:
    """Of every document: number of ids, the digest of the ids and the digest of the text decoded from them."""
    bound_batches(docs.sparkSession)
    spec = _spec(docs.sparkSession, path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(spec.value)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for rows, t in blocks(batches, "text", BLOCK):
            ids, offs = encode_block(v, t, threads)
            shown, at = gather(*v.decimal, ids)
            shown, at = shown.tobytes(), at[offs].tolist()
            coded = [digest(shown[a : max(a, b - 1)]) for a, b in zip(at, at[1:])]
            decoded = [digest(x) for x in decode_block(v, ids, offs)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offs).astype(np.int64)), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
