"""Secret scan with multipart credential linking, in built-in functions only.

Three base kinds are always reported: ``assign`` (a keyword with a value),
``access`` (an access-key id) and ``hex`` (a long hexadecimal run).  Weak
candidates (a user name, a random-looking token, a service address) are common
in harmless texts; they are reported only if the parts that complete a
credential stand within ``SCOPE`` code points of them:

- ``user`` with a secret (assign, hex or token),
- ``token`` with an identifier (access or user) or an endpoint,
- ``endpoint`` with an identifier and a secret.

Parts meet in an interval join: each part is posted to the bins of ``SCOPE`` code
points that its scope touches, joined on document and bin, and compared there.

Positions are code points, ends exclusive.  ``split`` and ``regexp_extract_all``
give the stretches between and inside matches, whose lengths add up to them.
The n matches of a text are added up in about sqrt(n) runs of sqrt(n), so a text
of 10 MB that is nothing but matches takes seconds.  Weak spans that overlap a
base span are found by an interval join too, never by comparing all with all.

Defined results: a null text is empty and has no spans; rows that repeat id and
text get the same result each; a null id is carried and its texts are told apart
by their hash; equal starts are ordered by kind as listed; an empty table gives
an empty result.  Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import materialize, read_table

SCOPE = 200

KINDS = ("assign", "access", "hex", "user", "token", "endpoint")
# The base patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
# Runs of one class are maximal, so a least length can stand in the pattern.
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"

USER = r"""(?i:user(?:_?name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
TOKEN = r"[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"""(?i:https?|postgres|mysql|mongodb|redis|amqp|ftp)://[^\x20\x09-\x0D"'<>]+"""
#: What a text must have for a pattern to be tried.
HINTS = {"assign": r"(?i:passw|secret|token|api_?key)", "user": r"(?i:user|login|client|account)"}

_NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, kind: str, pattern: str, hint: Column, value_group: int = 0, keep=None) -> Column:
    """The matches of ``pattern`` as structs of start, kind and end; ``keep`` filters by the value group."""
    between, inside = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    steps = F.arrays_zip(between.alias("b"), inside.alias("m"), value.alias("v"))
    code = KINDS.index(kind)
    inner = lambda x: F.coalesce(F.length(x["m"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + inner(x)
        span = F.array(F.struct(start.alias("start"), F.lit(code).alias("kind"), end.alias("end")))
        good = x["m"].isNotNull() & (keep(x["v"]) if keep else F.lit(True))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    empty = F.array().cast(_NO_SPANS)

    def in_runs(all_steps: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_steps))).cast("int")
        runs = F.transform(F.sequence(F.lit(1), F.size(all_steps), size), lambda i: F.slice(all_steps, i, size))
        return _let(runs, lambda r: F.flatten(F.zip_with(r, _starts(r), one_run)))

    def _starts(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda n, x: n + F.length(x["b"]) + inner(x)))
        return F.slice(F.aggregate(totals, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))), 1, F.size(runs))

    def one_run(run: Column, at: Column) -> Column:
        return F.aggregate(run, F.struct(at.alias("at"), empty.alias("found")), step, lambda acc: acc["found"])

    return F.when(hint, _let(steps, in_runs)).otherwise(empty)


def _shown(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_and_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, base (spans of the base kinds), weak (spans of the weak ones, overlaps with base included)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(
        _spans(text, "assign", ASSIGN, text.rlike(HINTS["assign"]), 2, lambda v: F.length(v) >= ASSIGN_VALUE),
        _spans(text, "access", LONG_ACCESS, text.contains("AKIA")),
        _spans(text, "hex", LONG_HEX, text.rlike(LONG_HEX)),
    )
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    weak = F.concat(
        _spans(text, "user", USER, text.rlike(HINTS["user"])),
        _spans(text, "token", TOKEN, text.rlike(TOKEN), 0, mixed),
        _spans(text, "endpoint", ENDPOINT, text.contains("://")),
    )
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), base.alias("base"), weak.alias("weak"))


_KEY = ("doc_id", "text_hash", "start", "kind", "end")


def _binned(spans: DataFrame, margin: int = 0) -> DataFrame:
    """The spans in every bin of ``SCOPE`` code points that they touch, or come as near to as ``margin``."""
    return spans.withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - margin) / SCOPE), F.floor((F.col("end") + margin) / SCOPE))))


def _near(wanted: DataFrame, others: DataFrame, margin: int) -> DataFrame:
    """Of the wanted spans, those that share a code point with one of the others, or come as near as ``margin`` (0: touch)."""
    a, b = _binned(wanted, margin).alias("a"), _binned(others).alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")) & (F.col("a.bin") == F.col("b.bin"))
    if margin:
        within = (F.col("b.start") <= F.col("a.end") + margin) & (F.col("b.end") >= F.col("a.start") - margin)
    else:
        within = (F.col("b.start") < F.col("a.end")) & (F.col("b.end") > F.col("a.start"))
    return a.join(b, same & within, "left_semi").select(*_KEY).distinct()


def clear_parts(found: DataFrame) -> DataFrame:
    """The distinct spans of the texts that have weak ones: all base spans, and the weak ones that overlap none of those."""
    spans = found.where(F.size("weak") > 0).select("doc_id", "text_hash", F.explode(F.concat("base", "weak")).alias("s")).distinct()
    spans = materialize(spans.select("doc_id", "text_hash", "s.start", "s.kind", "s.end"), "secret-spans")
    base, weak = spans.where("kind < 3"), spans.where("kind >= 3")
    covered = _near(weak, base, 0).alias("c")
    w = weak.alias("w")
    same = F.col("w.doc_id").eqNullSafe(F.col("c.doc_id"))
    for c in _KEY[1:]:
        same = same & (F.col(f"w.{c}") == F.col(f"c.{c}"))
    return materialize(base.unionAll(w.join(covered, same, "left_anti")), "secret-clear")


def linked(found: DataFrame) -> DataFrame:
    """doc_id, text_hash and the weak spans that complementary parts complete."""
    spans = clear_parts(found)
    of = lambda *kinds: spans.where(F.col("kind").isin([KINDS.index(k) for k in kinds]))
    users = _near(of("user"), of("assign", "hex", "token"), SCOPE)
    tokens = _near(of("token"), of("access", "user", "endpoint"), SCOPE)
    endpoints = _near(_near(of("endpoint"), of("access", "user"), SCOPE), of("assign", "hex", "token"), SCOPE)
    every = users.unionAll(tokens).unionAll(endpoints)
    return every.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and all spans (arrays of start, kind, end; kinds by place in ``KINDS``) of every document."""
    found = materialize(base_and_parts(docs, id_col, text_col), "secret-parts")
    more = linked(found).alias("m")
    f = found.alias("f")
    joined = f.join(more, F.col("f.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("f.text_hash") == F.col("m.text_hash")), "left")
    return joined.select("f.doc_id", "base", F.concat("base", F.coalesce("more", F.array().cast(_NO_SPANS))).alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"))
