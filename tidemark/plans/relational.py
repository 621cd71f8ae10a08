"""Joins, ledgers, ranks and vector queries on the wide tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import stable_bucket
from ..functions.vectors import cosine, is_valid
from ..operators import allocation, ledger, ranking, vector_search
from ..operators.intervals import binned_range_join

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_sql(expr: str, n: int) -> str:
    return f"(('0x' || substr(sha256({expr}::varchar), 1, 16))::UBIGINT % {n})::int"


def n_rows():
    return F.count(F.lit(1))


@query("join_inner_count", "SELECT c_mktsegment, count(*) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def join_inner_count(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return o.join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(n_rows().alias("n_orders"))


@query("recall_compare", f"SELECT c_mktsegment, count(*) AS members, count(o_custkey) AS retrieved, count(*) - count(o_custkey) AS missed FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE {bucket_sql('o_custkey', 10)} < 6) ON c_custkey = o_custkey GROUP BY c_mktsegment")
def recall_compare(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select("o_custkey").where(stable_bucket(F.col("o_custkey").cast("string"), 10) < 6).distinct()
    j = table(spark, sf_dir, "customer").join(found, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_mktsegment").agg(n_rows().alias("members"), F.count("o_custkey").alias("retrieved"), F.count_if(F.col("o_custkey").isNull()).alias("missed"))


@query("semi_join_population", "SELECT o_orderstatus, count(*) AS n_orders FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY o_orderstatus")
def semi_join_population(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(rich, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(n_rows().alias("n_orders"))


@query("anti_join_exclusion", "SELECT c_mktsegment, count(*) AS members FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS state FROM orders GROUP BY o_custkey) WHERE state IN ('O', 'P')) GROUP BY c_mktsegment")
def anti_join_exclusion(spark, sf_dir):
    ledger_rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderstatus").alias("state"))
    held = allocation.held_users(ledger_rows, "c_custkey", "o_orderkey", ("O", "P"))
    return table(spark, sf_dir, "customer").join(held, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(n_rows().alias("members"))


@query("not_exists_nested", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c.c_custkey AND l_returnflag = 'R')")
def not_exists_nested(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    bad = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(bad, "c_custkey", "left_anti")


@query("active_target_rule", "SELECT c_custkey FROM customer c WHERE c_custkey % 10 <> 0 AND (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey) OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus <> 'F'))")
def active_target_rule(spark, sf_dir):
    """Customers as targets, bound by their orders to runs, which ended if filled."""
    targets = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "stopped").otherwise("confirmed").alias("status"))
    orders = table(spark, sf_dir, "orders")
    bindings = orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("run_id"))
    runs = orders.select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))
    return allocation.active_targets(targets, bindings, runs, ["c_custkey"]).select("c_custkey")


@query(
    "uplift_units_join",
    "SELECT r_name, count(*) AS units, count(vec_id) AS with_vector, round(sum(l_quantity), 2) AS quantity FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN embeddings ON vec_id = c_custkey GROUP BY r_name",
)
def uplift_units_join(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = j.join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("embeddings").select("vec_id"), F.col("vec_id") == F.col("c_custkey"), "left")
    return j.groupBy("r_name").agg(n_rows().alias("units"), F.count("vec_id").alias("with_vector"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("case_order", "SELECT o_orderkey, o_orderpriority, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderkey")
def case_order(spark, sf_dir):
    rank = F.when(F.col("o_orderpriority") == "2-HIGH", 0).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(2)
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.orderBy(rank, "o_orderkey").select("o_orderkey", "o_orderpriority", "c_mktsegment")


@query("unbound_or_active", "SELECT min(c_custkey) AS c_custkey FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS state FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey WHERE state IS NULL OR state = 'P'")
def unbound_or_active(spark, sf_dir):
    now = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("state"))
    j = table(spark, sf_dir, "customer").select("c_custkey").join(now, "c_custkey", "left").where("state IS NULL OR state = 'P'")
    return j.agg(F.min("c_custkey").alias("c_custkey"))


def _snapshots(spark, sf_dir):
    """Orders as snapshots of their customer's plan, their lines' suppliers as members, and what happened to those as reservations."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    snapshots = o.select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("plan_id"), (F.col("o_orderkey") % 7).alias("final_user_count"))
    members = li.select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_suppkey").alias("user_id"))
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    state = F.when(F.col("l_returnflag") == "R", "released").when(F.col("l_returnflag") == "A", "consumed").otherwise("reserved")
    reservations = lines.select(F.col("o_custkey").alias("plan_id"), F.col("l_suppkey").alias("user_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.col("l_partkey")).alias("revision"), state.alias("state"))
    return snapshots, members, reservations


@query(
    "every_member_reserved",
    "WITH x AS (SELECT o_custkey AS p, l_suppkey AS u, l_orderkey AS k, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey AS r, CASE l_returnflag WHEN 'R' THEN 'released' WHEN 'A' THEN 'consumed' ELSE 'reserved' END AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT p, u, max({'r': r, 'f': f}).f AS f FROM x GROUP BY p, u) SELECT k AS snapshot_id FROM x JOIN s USING (p, u) GROUP BY k HAVING bool_and(s.f <> 'released')",
)
def every_member_reserved(spark, sf_dir):
    """Relational division: snapshots all of whose members have a reservation."""
    return allocation.wholly_reserved(*_snapshots(spark, sf_dir))


@query("snapshot_integrity", "SELECT o_orderkey AS snapshot_id, coalesce(n, 0) AS members, coalesce(d, 0) AS distinct_members, coalesce(n, 0) = o_orderkey % 7 AS count_matches, coalesce(n, 0) = coalesce(d, 0) AS members_distinct, coalesce(n, 0) > 0 AS not_empty FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def snapshot_integrity(spark, sf_dir):
    snapshots, members, _ = _snapshots(spark, sf_dir)
    return allocation.integrity(snapshots, members)


@query("join_json_path", "SELECT s_suppkey, count(*) AS n_events FROM events JOIN supplier ON s_suppkey = CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) GROUP BY s_suppkey")
def join_json_path(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("s_suppkey"))
    return e.join(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").groupBy("s_suppkey").agg(n_rows().alias("n_events"))


@query(
    "retry_lookup",
    "SELECT l_orderkey AS plan_id, l_orderkey * 10 + l_linenumber AS snapshot_id, l_linenumber AS segment_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 2 = 1 AND o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'P') GROUP BY o_orderkey HAVING list_sort(list(DISTINCT l_linenumber)) = [1, 2, 3])",
)
def retry_lookup(spark, sf_dir):
    """The settled plans that were made from segments 1, 2 and 3 and their sources."""
    status = F.when(F.col("o_orderstatus") == "F", "finalized").when(F.col("o_orderstatus") == "P", "locked").otherwise("open")
    promotion = F.concat(F.lit("p"), (F.col("o_custkey") % 2).cast("string"))
    plans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), promotion.alias("promotion_id"), F.col("o_orderpriority").alias("target_analysis_id"), status.alias("status"))
    n = F.col("l_linenumber")
    snapshots = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), (F.col("l_orderkey") * 10 + n).alias("snapshot_id"), n.alias("segment_id"), F.concat(F.lit("s"), n.cast("string")).alias("source_snapshot_id"))
    return allocation.retry(plans, snapshots, "p1", "1-URGENT", ["3", "1", "2"], ["s1", "s2", "s3"]).select("plan_id", "snapshot_id", "segment_id")


@query("unnest_with_ordinality", "SELECT c_custkey, unnest(string_split(c_name, '#')) AS part, unnest(range(1, len(string_split(c_name, '#')) + 1)) AS ordinal FROM customer")
def unnest_with_ordinality(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.split("c_name", "#")).alias("pos", "part"))
    return rows.select("c_custkey", "part", (F.col("pos") + 1).cast("long").alias("ordinal"))


@query("binned_range_join", "SELECT l_orderkey, count(*) AS pairs FROM lineitem JOIN part ON p_partkey % 5 = l_linenumber AND l_quantity >= p_size AND l_quantity < p_size + 4 GROUP BY l_orderkey")
def range_join(spark, sf_dir):
    """Parts of one key and size are one range with their number, so the join doesn't grow as lines times parts."""
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("key"), F.col("l_quantity").alias("at"))
    ranges = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 5).alias("key"), F.col("p_size").alias("start"), (F.col("p_size") + 4).alias("end")).agg(n_rows().alias("parts"))
    return binned_range_join(points, ranges, "key", "at", "start", "end", 8).groupBy("l_orderkey").agg(F.sum("parts").alias("pairs"))


# Ledger

_OLD = "SELECT o_custkey, o_orderkey AS revision, o_orderstatus AS state FROM orders WHERE o_orderkey % 2 = 0"
_NEW = "SELECT o_custkey, o_orderkey AS revision, o_orderstatus AS state FROM orders WHERE o_orderkey % 2 = 1"


def _halves(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("revision"), F.col("o_orderstatus").alias("state"))
    return o.where("revision % 2 = 0"), o.where("revision % 2 = 1")


@query("upsert_latest_wins", f"SELECT o_custkey, max(revision) AS revision, arg_max(state, revision) AS state FROM ({_OLD} UNION ALL {_NEW}) GROUP BY o_custkey")
def upsert_latest_wins(spark, sf_dir):
    return ledger.upsert_latest_wins(*_halves(spark, sf_dir), ["o_custkey"], ["revision"])


@query("insert_if_absent", f"SELECT o_custkey, min(revision) AS revision, arg_min(state, revision) AS state FROM ({_NEW}) WHERE o_custkey NOT IN (SELECT o_custkey FROM ({_OLD})) GROUP BY o_custkey")
def insert_if_absent(spark, sf_dir):
    return ledger.insert_if_absent(*_halves(spark, sf_dir), ["o_custkey"], "revision")


@query("upsert_coalesce", f"WITH o AS (SELECT o_custkey, max(revision) AS revision, arg_max(state, revision) AS state FROM ({_OLD}) GROUP BY o_custkey), n AS (SELECT o_custkey, max(revision) AS revision, arg_max(state, revision) AS state FROM ({_NEW}) GROUP BY o_custkey) SELECT o_custkey, coalesce(n.revision, o.revision) AS revision, coalesce(o.state, n.state) AS state FROM o FULL JOIN n USING (o_custkey)")
def upsert_coalesce(spark, sf_dir):
    old, new = (ledger.latest(x, ["o_custkey"], ["revision"]) for x in _halves(spark, sf_dir))
    return ledger.upsert_coalesce(old, new, ["o_custkey"], ["state"])


@query("ledger_transition", f"SELECT o_custkey, 'consumed' AS state, revision + 1 AS revision FROM (SELECT o_custkey, max(revision) AS revision, arg_max(state, revision) AS state FROM ({_OLD}) GROUP BY o_custkey) WHERE state = 'O' AND o_custkey % 2 = 0")
def ledger_transition(spark, sf_dir):
    old, _ = _halves(spark, sf_dir)
    asked = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("consumed").alias("state"))
    return ledger.transition(old, ["o_custkey"], asked, {"consumed": ["O"], "released": ["O", "P"]}).select("o_custkey", "state", "revision")


@query("latest_by_key", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def latest_by_key(spark, sf_dir):
    return ledger.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


@query("duplicate_members", "SELECT o_custkey, o_orderstatus, count(*) AS n_rows FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1")
def duplicate_members(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(n_rows().alias("n_rows")).where("n_rows > 1")


@query("scalar_subquery_count", "SELECT r_name, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders FROM region")
def scalar_subquery_count(spark, sf_dir):
    opened = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return spark.sql("SELECT r_name, (SELECT count(*) FROM {opened}) AS open_orders FROM {region}", opened=opened, region=table(spark, sf_dir, "region"))


# Windows, ranks and samples


@query("latest_revision", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_revision(spark, sf_dir):
    return ranking.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("latest_per_segment", "SELECT c_mktsegment, max(c_custkey) AS c_custkey FROM customer GROUP BY c_mktsegment")
def latest_per_segment(spark, sf_dir):
    return ledger.latest(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], ["c_custkey"])


@query("distinct_on_latest", "SELECT DISTINCT ON (o_orderpriority) o_orderpriority, o_orderkey, o_orderstatus FROM orders ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey DESC")
def distinct_on_latest(spark, sf_dir):
    return ledger.latest(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "allocation_winners",
    "SELECT l_partkey AS user_id, l_suppkey AS segment_id, l_suppkey AS snapshot_id, round(fit, 6) AS normalized_fit FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY s_nationkey, fit DESC NULLS LAST, l_suppkey) AS r FROM (SELECT *, (l_quantity - 10) / nullif(s_suppkey % 4, 0) AS fit FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40))) WHERE r = 1",
)
def allocation_winners(spark, sf_dir):
    """Suppliers as sources, their parts as members: one segment per user, users of large parts are excluded."""
    members = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("snapshot_id"), F.col("l_partkey").alias("user_id"), F.col("l_quantity").alias("behavior_fit_score"))
    key = F.col("s_suppkey")
    sources = table(spark, sf_dir, "supplier").select(key.alias("segment_id"), key.alias("snapshot_id"), F.col("s_nationkey").alias("priority"), F.lit(10.0).alias("score_threshold"), (key % 4).cast("double").alias("semantic_margin"))
    excluded = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("user_id"))
    found = allocation.winners(members, sources, excluded)
    return found.withColumn("normalized_fit", F.round("normalized_fit", 6))


#: segment, snapshot, priority, threshold, margin, least users
_SOURCES = [("a", 1, 2, 10.0, 2.0, 100), ("b", 2, 1, 20.0, 0.0, 700), ("c", 3, 1, 5.0, 4.0, 10), ("d", 4, 3, 0.0, 1.0, 1)]


@query(
    "allocation_preview",
    f"""WITH s(segment_id, snapshot_id, priority, threshold, margin, least_users) AS (VALUES {", ".join(map(str, _SOURCES))}),
  i AS (SELECT *, row_number() OVER (ORDER BY segment_id) - 1 AS i FROM s), x AS (SELECT mask, i.* FROM i, (SELECT unnest(range(1, 16)) AS mask) WHERE (mask >> i) & 1 = 1),
  names AS (SELECT mask, list(segment_id ORDER BY segment_id) AS segments FROM x GROUP BY mask),
  r AS (SELECT mask, segment_id, row_number() OVER (PARTITION BY mask, l_partkey ORDER BY priority, (l_quantity - threshold) / nullif(margin, 0) DESC NULLS LAST, segment_id) AS r FROM x JOIN lineitem ON l_linenumber = snapshot_id),
  w AS (SELECT mask, segment_id, count(*) AS n FROM r WHERE r = 1 GROUP BY mask, segment_id)
  SELECT segments, x.segment_id, coalesce(n, 0) AS users, coalesce(n, 0) >= least_users AS meets_min_sample_size, CASE WHEN coalesce(n, 0) = 0 THEN 'no_eligible_audience' WHEN n < least_users THEN 'insufficient_sample' ELSE 'targetable' END AS audience_status
  FROM x JOIN names USING (mask) LEFT JOIN w ON w.mask = x.mask AND w.segment_id = x.segment_id""",
)
def allocation_preview(spark, sf_dir):
    """What every set of four segments would allocate, from one pass over the members."""
    sources = spark.createDataFrame(_SOURCES, "segment_id string, snapshot_id int, priority int, score_threshold double, semantic_margin double, min_sample_size long")
    members = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("snapshot_id"), F.col("l_partkey").alias("user_id"), F.col("l_quantity").alias("behavior_fit_score"))
    return allocation.preview(members, sources)


@query("retrieval_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def retrieval_rank(spark, sf_dir):
    return ranking.global_rank(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("recent_topn", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_topn(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey")


@query("keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 25")
def keyset_page(spark, sf_dir):
    return ranking.keyset_page(table(spark, sf_dir, "orders"), "o_orderkey", 100, 25).select("o_orderkey", "o_custkey")


@query("salted_sample", "SELECT c_custkey FROM customer ORDER BY md5(c_custkey || 'salt1'), c_custkey LIMIT 40")
def salted_sample(spark, sf_dir):
    return ranking.salted_sample(table(spark, sf_dir, "customer"), "c_custkey", "salt1", 40).select("c_custkey")


@query("stable_topk_sample", "SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY ('0x' || substr(sha256(o_custkey::varchar), 1, 16))::UBIGINT, o_custkey LIMIT 30")
def stable_topk_sample(spark, sf_dir):
    return ranking.stable_sample(table(spark, sf_dir, "orders"), "o_custkey", 30)


@query("seeded_user_order", "SELECT c_custkey FROM customer ORDER BY sha1('seed7:' || c_custkey), c_custkey LIMIT 25")
def seeded_user_order(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy(F.sha1(F.concat(F.lit("seed7:"), F.col("c_custkey").cast("string"))), "c_custkey").limit(25).select("c_custkey")


@query("strength_ratio_cut", "SELECT c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r, ceil(count(*) OVER (PARTITION BY c_mktsegment) * 0.2) AS cut FROM customer) WHERE r <= cut OR cut < 30")
def strength_ratio_cut(spark, sf_dir):
    return ranking.strength_cut(table(spark, sf_dir, "customer"), ["c_mktsegment"], F.col("c_acctbal"), "c_custkey", 0.2, 30).select("c_custkey")


@query("jaccard_overlap", "WITH m AS (SELECT DISTINCT o_orderpriority AS g, o_custkey AS u FROM orders), n AS (SELECT g, count(*) AS n FROM m GROUP BY g) SELECT a.g AS \"left\", b.g AS \"right\", round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 9) AS similarity FROM m a JOIN m b ON a.u = b.u AND a.g < b.g JOIN n x ON x.g = a.g JOIN n y ON y.g = b.g GROUP BY a.g, b.g")
def jaccard_overlap(spark, sf_dir):
    found = ranking.jaccard(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey")
    return found.select("left", "right", F.round("similarity", 9).alias("similarity"))


@query("missed_members", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def missed_members(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").exceptAll(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct())


@query("dedupe_best", "SELECT o_custkey, arg_max(o_orderkey, {'p': o_totalprice, 'k': -o_orderkey}) AS o_orderkey FROM orders GROUP BY o_custkey")
def dedupe_best(spark, sf_dir):
    return ranking.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("contains_all", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING len(list_filter(list(DISTINCT o_orderstatus), lambda x: x IN ('O', 'F', 'P'))) = 3")
def contains_all(spark, sf_dir):
    have = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("have"))
    wanted = F.array(F.lit("O"), F.lit("F"), F.lit("P"))
    return have.where(F.size(F.array_except(wanted, "have")) == 0).select("o_custkey")


@query("leave_last_out", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS outcome, count(*) - 1 AS observed FROM orders GROUP BY o_custkey")
def leave_last_out(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("outcome"), (n_rows() - 1).alias("observed"))


@query("holdout_allocation", "SELECT c_custkey, CASE WHEN r <= least(greatest(floor(n * 0.7 + 0.5), 1), n - 1) THEN 'treatment' ELSE 'control' END AS arm, round(least(greatest(floor(n * 0.7 + 0.5), 1), n - 1) / n, 9) AS probability FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)")
def holdout_allocation(spark, sf_dir):
    from ..operators.experiments import holdout

    return holdout(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 0.7).select("c_custkey", "arm", F.round("treatment_probability", 9).alias("probability"))


# Vectors

_CENTROID = "SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::double AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label"
_QUERY_SQL = "(SELECT embedding::double[] FROM embeddings WHERE vec_id = 0)"
_SCORE = f"list_cosine_similarity(embedding::double[], {_QUERY_SQL})"


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e, e.where("vec_id = 0").first()["embedding"]


@query("vector_centroid", f"SELECT label, list_transform(c, lambda x: round(x / sqrt(list_dot_product(c, c)), 6)) AS centroid FROM ({_CENTROID})")
def vector_centroid(spark, sf_dir):
    found = vector_search.centroids(table(spark, sf_dir, "embeddings"), "label")
    return found.select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query("cosine_exact", f"SELECT vec_id, round({_SCORE}, 6) AS score FROM embeddings WHERE {_SCORE} >= 0.1")
def cosine_exact(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    return vector_search.above(e, q, 0.1).select("vec_id", F.round("score", 6).alias("score"))


@query("cosine_topk", f"SELECT vec_id, round({_SCORE}, 6) AS score FROM embeddings ORDER BY {_SCORE} DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    return vector_search.top_k(e, q, 20, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("candidate_refilter", f"SELECT vec_id, round({_SCORE}, 6) AS score FROM embeddings WHERE label = 3 AND {_SCORE} >= 0.0")
def candidate_refilter(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    ids = e.where("label = 3").select("vec_id")
    return vector_search.above(e.join(ids, "vec_id", "left_semi"), q, 0.0).select("vec_id", F.round("score", 6).alias("score"))


@query("score_pass_rate", f"SELECT count(*) AS sampled, count(*) FILTER (s >= 0.05) AS passed, round(count(*) FILTER (s >= 0.05) / count(*), 6) AS rate FROM (SELECT {_SCORE} AS s FROM embeddings ORDER BY md5(vec_id || 'probe'), vec_id LIMIT 200)")
def score_pass_rate(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    return vector_search.pass_rate(e, q, 0.05, "vec_id", "probe", 200)


@query(
    "recall_audit",
    f"""WITH w AS (SELECT count(*) FILTER (label <> 0 AND {_SCORE} >= 0.0) AS g, count(*) FILTER (label = 0) AS s FROM embeddings),
  a AS (SELECT count(*) AS n, count(*) FILTER ({_SCORE} >= 0.0) AS m, 1.959963984540054::double AS z FROM (SELECT * FROM embeddings WHERE label = 0 ORDER BY md5(vec_id || 'audit'), vec_id LIMIT 100)),
  u AS (SELECT *, least((m / n + z * z / (2 * n) + z * sqrt(m / n * (1 - m / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1.0) AS up FROM a, w)
  SELECT g AS retrieved_positive, s AS population, n AS audited, m AS missed, round(g / (g + m / n * s), 6) AS estimated_recall, round(g / (g + up * s), 6) AS recall_lower_bound, g / (g + up * s) >= 0.95 AS accepted FROM u""",
)
def recall_audit(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    found = vector_search.recall_audit(e, q, 0.0, e.where("label <> 0"), "vec_id", "audit", 100)
    return found.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes))


@query("value_lists_if", "SELECT o_custkey, list_sort(list(o_orderkey) FILTER (o_orderstatus = 'F')) AS filled, coalesce(len(list(o_orderkey) FILTER (o_orderstatus = 'F')), 0)::int AS n_filled FROM orders GROUP BY o_custkey HAVING n_filled > 0")
def value_lists_if(spark, sf_dir):
    """The values of the rows that meet a condition, as a sorted list."""
    filled = F.sort_array(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(filled.alias("filled")).select("o_custkey", "filled", F.size("filled").alias("n_filled")).where("n_filled > 0")


@query("positives_of_candidates", "SELECT c_mktsegment AS candidate, count(*) AS members, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS positives FROM customer GROUP BY c_mktsegment")
def positives_of_candidates(spark, sf_dir):
    """Per candidate, its members and how many of them are positive."""
    members = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("candidate"), F.col("c_custkey").alias("user_id"))
    positives = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"))
    return ranking.overlap_counts(members, positives, "candidate", "user_id")


def _segments(spark, sf_dir):
    return vector_search.centroids(table(spark, sf_dir, "embeddings"), "label").withColumn("segment_id", F.concat(F.lit("s"), F.col("label").cast("string")))


_RANKED = f"SELECT vec_id, 's' || c.label AS segment_id, list_cosine_similarity(embedding::double[], c) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::double[], c) DESC, 's' || c.label) AS rank FROM embeddings, ({_CENTROID}) c"


@query("lateral_topk", f"SELECT vec_id, segment_id, rank, round(score, 6) AS score FROM ({_RANKED}) WHERE rank <= 3")
def lateral_topk(spark, sf_dir):
    found = vector_search.nearest_segments(table(spark, sf_dir, "embeddings"), _segments(spark, sf_dir), 3)
    rows = found.select("vec_id", F.posexplode("nearest").alias("p", "s"))
    return rows.select("vec_id", F.col("s.id").alias("segment_id"), (F.col("p") + 1).cast("long").alias("rank"), F.round("s.score", 6).alias("score"))


@query("segment_match", f"SELECT vec_id, CASE WHEN score >= 0.5 THEN segment_id ELSE 'fallback' END AS segment_id, round(score, 6) AS similarity_score, score < 0.5 AS is_fallback, CASE WHEN score < 0.5 THEN 'below_threshold' END AS fallback_reason FROM ({_RANKED}) WHERE rank = 1")
def segment_match(spark, sf_dir):
    found = vector_search.match_segments(table(spark, sf_dir, "embeddings"), _segments(spark, sf_dir), 64)
    return found.select("vec_id", "segment_id", F.round("similarity_score", 6).alias("similarity_score"), "is_fallback", "fallback_reason")


@query("vector_validate", "SELECT vec_id, vec_id % 7 <> 0 AND vec_id % 11 <> 0 AS valid FROM embeddings")
def vector_validate(spark, sf_dir):
    v = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 11 == 0, F.transform("embedding", lambda x: x * F.lit(0).cast("float"))).otherwise(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", is_valid(v, 64).alias("valid"))


@query("required_first_topk", f"SELECT vec_id FROM embeddings ORDER BY CASE WHEN label = 2 THEN 0 ELSE 1 END, round({_SCORE}, 9) DESC, vec_id LIMIT 60")
def required_first_topk(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    own = vector_search.scored(e, q)
    return own.orderBy(F.when(F.col("label") == 2, 0).otherwise(1), F.round("score", 9).desc(), "vec_id").limit(60).select("vec_id")


@query("similarity_histogram", f"SELECT CASE WHEN s < 0 THEN 'negative' WHEN s < 0.25 THEN 'low' WHEN s < 0.5 THEN 'middle' ELSE 'high' END AS bucket, count(*) AS n_vectors FROM (SELECT {_SCORE} AS s FROM embeddings) GROUP BY ALL")
def similarity_histogram(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    s = cosine(F.col("embedding"), vector_search.literal(q))
    bucket = F.when(s < 0, "negative").when(s < 0.25, "low").when(s < 0.5, "middle").otherwise("high")
    return e.groupBy(bucket.alias("bucket")).agg(n_rows().alias("n_vectors"))


@query("spherical_kmeans")
def spherical_kmeans(spark, sf_dir):
    return vector_search.spherical_kmeans(table(spark, sf_dir, "embeddings"), 4)
