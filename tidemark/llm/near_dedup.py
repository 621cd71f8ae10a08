"""MinHash near-duplicates by a signature-coordinate inverted join.

A text's set holds its distinct runs of five words, A-Z folded; a text of fewer
words has one, its whole sequence.  Texts with equal sets form a class, and the
class's smallest id stands for it from then on.

1. Each class is posted under every coordinate of its MinHash signature together
   with the value there.  Classes that agree in ``MATCHES`` of the ``COORDINATES``
   must meet in one of the ``PREFIX`` rarest postings of each, so only those are
   joined; postings that no other class has take up room in the prefix, so classes
   of which most postings are their own hardly meet at all.
2. All classes that meet under a posting go to the group of the posting's smallest
   class, with their signatures.  There the postings are inverted lists: for one
   class, the ``PREFIX`` shortest of its lists are merged and their collisions
   counted, the long lists are only probed for what came up, and pairs under
   ``MATCHES`` are dropped.  Classes that are already reached are skipped, which
   never changes what is connected.  The rest are candidates.
3. Connected candidates form clusters; the texts go there, once each, and pairs
   are confirmed on the full sets, skipping classes that are already linked.

Groups of more than ``BLOCK`` classes and clusters of more than ``CLUSTER`` classes
or ``CLUSTER_SHINGLES`` shingles are cut into blocks, each with a hub added: the
smallest class of a group, that with the most shared postings of a cluster.  What
isn't in the main component after that is held against every block, by signatures
alone.  Of clusters, only classes that a match leads to another component then
have their texts sent once more, to be confirmed block by block; no pair is ever
written.

A pair with similarity 0.75 agrees in fewer than ``MATCHES`` coordinates with a
probability of 1.9e-7.

Defined results: texts without words have an empty set and are linked with
nothing; so are null texts and rows with a null id (their component is null, and
they are kept); rows that repeat an id are one node, linked by any of its texts;
an empty table gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .staging import bound_batches, materialize, read_table, scratch
from .textblock import TextBlock, U, blocks, column, mix, per_text, repeated, stream

SHINGLE, SIMILARITY_PERCENT = 5, 75
COORDINATES, MATCHES = 128, 70
PREFIX = COORDINATES - MATCHES + 1
#: Signatures in a block of a group; texts in a block of a cluster, and their shingles.
BLOCK, CLUSTER, CLUSTER_SHINGLES = 2048, 512, 1 << 19

_FLIP, _SCALE = stream(COORDINATES, 303), stream(COORDINATES, 404) | U(1)


def shingles(t: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts, repeats included, and their offsets."""
    words = t.word_hashes(fold=True)
    at = t.window_starts(SHINGLE)
    short = t.woff[:-1][(t.n_words > 0) & (t.n_words < SHINGLE)]
    at = np.sort(np.concatenate([at, short]))
    ends = np.minimum(at + SHINGLE, t.woff[np.searchsorted(t.woff, at, "right")]) if len(at) else at
    return t.run_hash(words, at, ends), np.searchsorted(at, t.woff)


def signatures_of(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of 32-bit coordinates for each run of hashes; runs begin at ``starts`` and aren't empty."""
    out = np.empty((len(starts), COORDINATES), np.int32)
    for i in range(COORDINATES):
        out[:, i] = (np.minimum.reduceat((hashes ^ _FLIP[i]) * _SCALE[i], starts) >> U(32)).astype(np.uint32).view(np.int32)
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a hash of the text (own), n_shingles, a fingerprint of the set (f1, f2) and its signature (empty for an empty set)."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in blocks(batches, "text"):
            hashes, offs = shingles(t)
            _, first = repeated(hashes, np.repeat(np.arange(t.n), np.diff(offs)))
            own, at = hashes[first], np.concatenate([[0], np.cumsum(per_text(offs, first))])
            full = at[1:] > at[:-1]
            prints = np.zeros((2, t.n), np.int64)
            sig = np.zeros((0, COORDINATES), np.int32)
            if len(own):
                starts = at[:-1][full]
                prints[0, full] = np.add.reduceat(mix(own + U(1)), starts).view(np.int64)
                prints[1, full] = np.bitwise_xor.reduceat(mix(own + U(2)), starts).view(np.int64)
                sig = signatures_of(own, starts)
            where = np.concatenate([[0], np.cumsum(full * COORDINATES)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(where), pa.array(sig.reshape(-1)))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), lists], ["doc_id", "own", "n_shingles", "f1", "f2", "signature"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, own long, n_shingles long, f1 long, f2 long, signature array<int>")


def prefix_postings(classes: DataFrame) -> DataFrame:
    """rep, posting, n: of every class the rarest postings that it shares with others, as many as the prefix has room for."""
    posts = classes.select("rep", F.posexplode("signature").alias("at", "value")).select("rep", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long")).alias("posting"))
    # written first: a join straight on an aggregation can't split a value that very many classes have
    often = materialize(posts.groupBy("posting").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    shared = posts.join(often, "posting").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "posting"))).alias("own"))
    room = F.lit(PREFIX - COORDINATES) + F.size("own")  # what the class's postings of its own don't take
    return shared.where(room > 0).select("rep", F.explode(F.slice("own", 1, room)).alias("p")).select("rep", F.col("p.posting").alias("posting"), F.col("p.n").alias("n"))


class Postings:
    """The inverted lists of some signatures."""

    def __init__(self, sig: np.ndarray):
        self.sig, m = sig, np.arange(len(sig))[:, None]
        self.order = np.argsort(sig, axis=0, kind="stable")
        ranked = np.take_along_axis(sig, self.order, 0)
        new = np.ones(sig.shape, bool)
        new[1:] = ranked[1:] != ranked[:-1]
        begin = np.maximum.accumulate(np.where(new, m, 0), axis=0)
        last = np.ones(sig.shape, bool)
        last[:-1] = new[1:]
        end = np.minimum.accumulate(np.where(last, m + 1, len(sig))[::-1], axis=0)[::-1]
        self.begin, self.end = np.empty_like(begin), np.empty_like(end)
        np.put_along_axis(self.begin, self.order, begin, 0)
        np.put_along_axis(self.end, self.order, end, 0)

    def matches(self, d: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the wanted signatures, those that agree with ``d``'s in ``MATCHES`` coordinates, and in how many."""
        size = self.end[d] - self.begin[d]
        by = np.argsort(size, kind="stable")
        short, long = by[:PREFIX], by[PREFIX:]
        n = size[short]
        at = np.repeat(self.begin[d, short] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        count = np.bincount(self.order[at, np.repeat(short, n)], minlength=len(self.sig))
        found = np.flatnonzero((count > 0) & wanted)
        if not len(found):
            return found, found
        count = count[found] + (self.sig[found[:, None], long] == self.sig[d, long]).sum(1)
        good = count >= MATCHES
        return found[good], count[good]


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted rows by their keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        cols = [np.asarray(column(batch, k)) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _per_group(rows: DataFrame, keys: tuple[str, ...], work, schema: str) -> DataFrame:
    """``work`` on the rows of each key, in sorted streams; it returns a tuple of arrays for the schema's longs."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for table in _groups(batches, keys):
            found = work(table)
            if len(found[0]):
                out.append(found)
                n += len(found[0])
            if n >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names)
                out, n = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


def _signatures(table: pa.Table) -> np.ndarray:
    return table["signature"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)


def _reach(n: int, found_by) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect n nodes as all links would: from a node to those not reached yet that ``found_by`` gives for it."""
    left = np.ones(n, bool)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for first in range(n):
        todo = [first] if left[first] else []
        left[first] = False
        while todo and left.any():
            d = todo.pop()
            found = found_by(d, left)
            left[found] = False
            todo += found.tolist()
            a.append(np.full(len(found), d))
            b.append(found)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a or none).astype(np.int64), np.concatenate(b or none).astype(np.int64)


def candidate_block(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the classes of one block of a group as all candidate pairs would."""
    reps, postings = _longs(table, "rep"), Postings(_signatures(table))
    a, b = _reach(len(reps), lambda d, left: postings.matches(d, left)[0])
    return reps[a], reps[b]


def _unique_sets(t: TextBlock) -> list[np.ndarray]:
    hashes, offs = shingles(t)
    return [np.unique(hashes[a:b]) for a, b in zip(offs, offs[1:])]


class _Sets:
    """The shingle sets of the texts of a table, and the sizes of their intersections."""

    def __init__(self, table: pa.Table):
        self.sets: list[np.ndarray] = []
        for rows in table.select(["text"]).combine_chunks().to_batches():
            for _, t in blocks(iter([rows]), "text"):
                self.sets += _unique_sets(t)
        self.sizes = np.array([len(s) for s in self.sets])
        flat, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.values, self.owner = flat[order], owner[order]

    def linked(self, d: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are as similar to ``d`` as a link takes."""
        own = self.sets[d]
        lo, hi = np.searchsorted(self.values, own, "left"), np.searchsorted(self.values, own, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(self.owner[at], minlength=len(self.sets))[others]
        return others[_similar(shared, len(own), self.sizes[others])]


def _similar(shared, a, b):
    return 100 * shared >= SIMILARITY_PERCENT * (a + b - shared)


def link_block(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the classes of one block of a cluster as all links would."""
    reps, postings, sets = _longs(table, "rep"), Postings(_signatures(table)), _Sets(table)

    def found_by(d: int, left: np.ndarray) -> np.ndarray:
        found = postings.matches(d, left)[0]
        return sets.linked(d, found) if len(found) else found

    a, b = _reach(len(reps), found_by)
    return reps[a], reps[b]


def _crossing(table: pa.Table, links) -> list[tuple[int, np.ndarray]]:
    """Of rows marked ``rest``, each with the others of another component that ``links`` gives for it, one for each component."""
    rest, comp = _longs(table, "rest"), _longs(table, "component").copy()
    out = []
    if rest.any() and not rest.all():
        for d in np.flatnonzero(rest).tolist():
            found = links(d, ~rest & (comp != comp[d]))
            _, first = np.unique(comp[found], return_index=True)
            for c in comp[found[first]].tolist():
                comp[comp == c] = comp[d]
            if len(found):
                out.append((d, found[first]))
    return out


def _edges(reps: np.ndarray, found: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = [np.zeros(0, np.int64)]
    return np.concatenate([np.full(len(x), reps[d]) for d, x in found] or none).astype(np.int64), np.concatenate([reps[x] for _, x in found] or none).astype(np.int64)


def cross_candidates(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the components of the rows marked ``rest`` with those of the others as all candidate pairs would."""
    postings = Postings(_signatures(table))
    return _edges(_longs(table, "rep"), _crossing(table, lambda d, wanted: postings.matches(d, wanted)[0]))


def cross_links(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The same for links, confirmed on the texts."""
    postings, sets = Postings(_signatures(table)), _Sets(table)

    def links(d: int, wanted: np.ndarray) -> np.ndarray:
        found = postings.matches(d, wanted)[0]
        return sets.linked(d, found) if len(found) else found

    return _edges(_longs(table, "rep"), _crossing(table, links))


def cross_wanted(table: pa.Table) -> tuple[np.ndarray, ...]:
    """grp, part, block, rep and role of the rows that have a candidate of another component on the other side."""
    rest, comp = _longs(table, "rest"), _longs(table, "component")
    wanted = np.zeros(len(rest), bool)
    if rest.any() and not rest.all():
        postings = Postings(_signatures(table))
        for d in np.flatnonzero(rest).tolist():
            found = postings.matches(d, ~rest & (comp != comp[d]))[0]
            wanted[found] = True
            wanted[d] = len(found) > 0
    return tuple(_longs(table, c)[wanted].astype(np.int64) for c in ("grp", "part", "block", "rep", "rest"))


def _blocked(rows: DataFrame) -> DataFrame:
    """A row for its own block, and for all blocks if it is the group's hub."""
    own = F.when(F.col("rep") == F.col("hub"), F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(F.array("home"))
    return rows.withColumn("block", F.explode(own))


def _home() -> F.Column:
    return F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int").alias("home")


def _across(large: DataFrame, per_block: int) -> DataFrame:
    """Signatures of what is outside of its group's main component, and of everything, dealt out so that each of the one meets each of the other."""
    main = large.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    rest = materialize(large.join(materialize(main, "main"), "grp").where("component <> main").drop("main"), "rest")
    parts = materialize(rest.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("parts")), "parts")
    part = F.pmod(F.xxhash64("rep", F.lit(1)), "parts").cast("int").alias("part")
    shown = ["grp", "rep", "signature", "component"]
    ours = rest.join(parts, "grp").select(*shown, part, F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), F.lit(True).alias("rest"))
    every = large.join(parts, "grp").select(*shown, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("home").alias("block"), F.lit(False).alias("rest"))
    return ours.unionAll(every)


def _with_components(rows: DataFrame, edges: DataFrame) -> DataFrame:
    return rows.join(components(edges).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


_EDGES = "a long, b long"


def candidates(classes: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (a, b) that connect classes as all pairs with ``MATCHES`` would; ``members`` has grp and rep."""
    sizes = materialize(members.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "sizes")
    dealt = members.join(sizes, "grp").select("grp", "rep", "n_blocks", _home())
    dealt = materialize(dealt.join(classes.select("rep", "signature").hint("merge"), "rep"), "members")
    first = materialize(_per_group(_blocked(dealt.withColumn("hub", F.col("grp"))).select("grp", "block", "rep", "signature"), ("grp", "block"), candidate_block, _EDGES), "candidates")
    large = dealt.where("n_blocks > 1")
    if large.limit(1).count() == 0:
        return first
    spread = _across(materialize(_with_components(large, first), "large"), BLOCK)
    second = _per_group(spread, ("grp", "part", "block"), cross_candidates, _EDGES)
    return first.unionAll(materialize(second, "candidates"))


def links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, posts: DataFrame) -> DataFrame:
    """Edges (a, b) that connect classes as all links would; ``clusters`` has rep and grp, the cluster's smallest class."""
    weight = posts.groupBy("rep").agg(F.sum("n").alias("weight"))
    sized = classes.select("rep", "n_shingles").join(clusters, "rep").join(weight, "rep")
    n_blocks = F.greatest(F.ceil(F.count(F.lit(1)) / CLUSTER), F.ceil(F.sum("n_shingles") / CLUSTER_SHINGLES)).cast("int")
    sizes = sized.groupBy("grp").agg(n_blocks.alias("n_blocks"), F.max_by("rep", F.struct("weight", "rep")).alias("hub"))
    known = materialize(clusters.join(materialize(sizes, "sizes"), "grp").select("grp", "rep", "hub", "n_blocks", _home()), "clusters")
    # always dealt out by id: a plan that broadcast few clusters and shuffled for many would cost several times more from some size on
    texts = docs.select(F.col("doc_id").alias("rep"), "text", F.xxhash64("text").alias("own")).hint("merge")
    dealt = known.join(classes.select("rep", "signature", "own").hint("merge"), "rep").join(texts, ["rep", "own"]).dropDuplicates(["rep", "own"])
    dealt = materialize(dealt, "dealt")
    first = materialize(_per_group(_blocked(dealt).select("grp", "block", "rep", "signature", "text"), ("grp", "block"), link_block, _EDGES), "links")
    large = dealt.where("n_blocks > 1")
    if large.limit(1).count() == 0:
        return first
    keys = ("grp", "part", "block")
    parts = materialize(_with_components(large.drop("text"), first), "large")
    wanted = materialize(_per_group(_across(parts, CLUSTER), keys, cross_wanted, "grp long, part long, block long, rep long, rest long"), "wanted")
    texts = large.select("rep", "own", "text").join(parts.select("rep", "own", "signature", "component"), ["rep", "own"])
    second = _per_group(wanted.withColumn("rest", F.col("rest") == 1).distinct().join(texts.hint("merge"), "rep"), keys, cross_links, _EDGES)
    return first.unionAll(materialize(second, "links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(docs), "signatures")
    key = ["n_shingles", "f1", "f2"]
    one = F.min_by(F.struct("signature", "own"), F.struct("doc_id", "own"))
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(key).agg(F.min("doc_id").alias("rep"), one.alias("one"))
    classes = materialize(classes.select(*key, "rep", "one.signature", "one.own"), "classes")
    with scratch(docs.sparkSession):
        posts = materialize(prefix_postings(classes.select("rep", "signature")), "postings")
        heads = posts.groupBy("posting").agg(F.min("rep").alias("grp"), F.count(F.lit(1)).alias("n")).where("n > 1").select("posting", "grp")
        heads = materialize(heads, "heads")
        members = materialize(posts.join(heads, "posting").select("grp", "rep").distinct(), "members")
        clusters = components(candidates(classes, members)).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
        found = materialize(components(links(docs, classes, clusters, posts).unionAll(_same_id(signed, classes, key))), "found", outer=True)
    classes = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    joined = signed.select("doc_id", *key).join(classes, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _same_id(signed: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Edges between the classes of rows that repeat an id."""
    twice = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    reps = signed.select("doc_id", *key).join(twice, "doc_id").join(classes.select(*key, "rep"), key).select("doc_id", "rep")
    return reps.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns; of rows that repeat its id, all."""
    verdicts = near_duplicates(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_td_id")).distinct().hint("merge")
    return docs.join(verdicts, docs[id_col].cast("long") == verdicts["_td_id"], "left_anti")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
