"""The registered queries of the library, and for each the same as ANSI SQL.

Doubles are rounded on both sides, behind all ranking, because engines add in
different orders.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricloom.functions.text import key_parts, list_length, normaliser, sentinel, target_key
from metricloom.operators import clean, curves, ranking, splits, stats
from metricloom.operators.ordering import checkpointed, dense_id
from metricloom.operators.quantiles import exact_quantiles
from metricloom.sources.tables import constants, geomspace, json_paths, optional_column, pairs, runs, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

RUNS = """runs AS (SELECT c_mktsegment AS method_id, CASE WHEN l_linestatus = 'F' THEN 'random' ELSE 'scaffold' END AS split,
  CAST(year(l_shipdate) AS INTEGER) AS train_size, CAST(11 * (1 + l_suppkey % 5) AS INTEGER) AS seed, avg(abs(l_discount - l_tax)) AS mae,
  sqrt(avg((l_discount - l_tax) * (l_discount - l_tax))) AS rmse, 1 - sum((l_discount - l_tax) * (l_discount - l_tax)) / (var_pop(l_tax) * count(*)) AS r2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE year(l_shipdate) BETWEEN 1995 AND 2001 GROUP BY 1, 2, 3, 4)"""
SUMM = RUNS + """, summ AS (SELECT split, train_size, method_id, count(DISTINCT seed) AS n_seeds, avg(mae) AS mean_mae, stddev_samp(mae) AS std_mae,
  avg(rmse) AS mean_rmse, stddev_samp(rmse) AS std_rmse, avg(r2) AS mean_r2, stddev_samp(r2) AS std_r2 FROM runs GROUP BY 1, 2, 3),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY split, train_size ORDER BY mean_mae, method_id) AS INTEGER) AS rnk FROM summ)"""
TESTS = SUMM + """, sp AS (SELECT a.split, a.train_size, a.seed, a.method_id AS m1, b.method_id AS m2, a.mae - b.mae AS d
  FROM runs a JOIN runs b ON a.split = b.split AND a.train_size = b.train_size AND a.seed = b.seed AND a.method_id < b.method_id),
  t0 AS (SELECT split, train_size, m1, m2, avg(d) AS mean_diff, stddev_samp(d) AS sd, count(*) AS n, (bool_and(d > 0) OR bool_and(d < 0)) AS agree FROM sp GROUP BY 1, 2, 3, 4),
  t1 AS (SELECT *, CASE WHEN sd = 0 THEN NULL ELSE mean_diff / (sd / sqrt(n)) END AS t FROM t0),
  t2 AS (SELECT *, abs(t) / sqrt(4 + t * t) AS s FROM t1),
  tests AS (SELECT split, train_size, m1, m2, mean_diff, agree, CASE WHEN sd = 0 THEN CASE WHEN mean_diff <> 0 THEN 0.0 END ELSE 1 - s * (1 + (1 - s * s) / 2) END AS p FROM t2),
  both_ways AS (SELECT split, train_size, m1, m2, mean_diff, p, agree, coalesce(p < 0.05 AND agree, false) AS resolved FROM tests
    UNION ALL SELECT split, train_size, m2, m1, mean_diff, p, agree, coalesce(p < 0.05 AND agree, false) FROM tests)"""
ADJ = TESTS + """, adj AS (SELECT r.split, r.train_size, r.rnk || '-' || (r.rnk + 1) AS rank_pair, r.method_id AS better, w.method_id AS worse, abs(b.mean_diff) AS abs_diff, b.p, b.agree, b.resolved
  FROM ranked r JOIN ranked w ON r.split = w.split AND r.train_size = w.train_size AND w.rnk = r.rnk + 1
  JOIN both_ways b ON b.split = r.split AND b.train_size = r.train_size AND b.m1 = r.method_id AND b.m2 = w.method_id)"""
TOP = TESTS + """, top AS (SELECT r.split, r.train_size, r.method_id AS rank1, r.mean_mae AS best_mae,
  coalesce((SELECT count(*) FROM both_ways b WHERE b.split = r.split AND b.train_size = r.train_size AND b.m1 = r.method_id AND NOT b.resolved), 0) + 1 AS top_size FROM ranked r WHERE r.rnk = 1)"""
PAIRS = """pairs AS (SELECT c.k, x, y, n, n_y FROM (SELECT c_nationkey AS k, avg(c_acctbal) AS x, count(*) AS n FROM customer GROUP BY 1) c
  JOIN (SELECT s_nationkey AS k, avg(s_acctbal) AS y, count(*) AS n_y FROM supplier GROUP BY 1) s ON c.k = s.k)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(*names: str, **more) -> list:
    return [F.round(n, 6).alias(n) for n in names] + [F.round(c, 6).alias(k) for k, c in more.items()]


# --- scans, projections, filters ---


@query("SELECT l_orderkey AS mol_id, l_quantity AS value FROM lineitem")
def scan_project(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_quantity").withColumnsRenamed({"l_orderkey": "mol_id", "l_quantity": "value"})


@query("SELECT label, count(*) AS n FROM orders JOIN (VALUES ('O', 'open'), ('F', 'filled'), ('P', 'partial')) v(code, label) ON o_orderstatus = code GROUP BY 1")
def constant_relation(spark, d):
    labels = constants(spark, [("O", "open"), ("F", "filled"), ("P", "partial")], "code string, label string")
    return table(spark, d, "orders").join(F.broadcast(labels), F.col("o_orderstatus") == F.col("code")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_scan_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", "p.k")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n FROM events GROUP BY 1")
def nested_field_access(spark, d):
    return table(spark, d, "events").select(F.from_json("props", "k long").alias("p")).groupBy((F.col("p.k") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT t.fullkey AS path, CASE WHEN t.type IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' ELSE t.type END AS type, count(*) AS n FROM events, json_tree(props) t GROUP BY 1, 2")
def props_paths(spark, d):
    """Paths of the events' properties with types and counts, no key known ahead."""
    return json_paths(table(spark, d, "events"), "props")


@query("""WITH made AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'not a list' WHEN 1 THEN '[]' WHEN 2 THEN '[' || n_chars || '.5, 2.0]' END AS t FROM documents)
 SELECT doc_id, CASE WHEN json_valid(t) AND json_type(t) = 'ARRAY' THEN CAST(json_array_length(t) AS INTEGER) ELSE 1 END AS n FROM made""")
def json_array_len(spark, d):
    made = F.when(F.col("doc_id") % 4 == 0, "not a list").when(F.col("doc_id") % 4 == 1, "[]").when(F.col("doc_id") % 4 == 2, F.format_string("[%d.5, 2.0]", "n_chars"))
    return table(spark, d, "documents").select("doc_id", list_length(made).alias("n"))


@query("""WITH ends AS (SELECT CAST(min(o_orderkey) + 1 AS DOUBLE) AS lo, CAST(max(o_orderkey) + 1 AS DOUBLE) AS hi FROM orders),
 g AS (SELECT i, round(lo * pow(hi / lo, i / 399.0), 6) AS x FROM range(400) r(i), ends)
 SELECT CAST(i AS BIGINT) AS i, x, (SELECT count(*) FROM orders WHERE o_orderkey + 1 <= x) AS n FROM g""")
def geomspace_grid(spark, d):
    """How many orders lie at or below each of 400 points of equal ratios from the least to the largest key, keys counted from 1."""
    keys = table(spark, d, "orders").select((F.col("o_orderkey") + 1).cast("double").alias("v")).where("v IS NOT NULL")
    low, high = keys.agg(F.min("v"), F.max("v")).first()
    g = geomspace(spark, low, high, 400).select("i", F.round("x", 6).alias("x"))
    grid = g.agg(F.sort_array(F.collect_list("x")).alias("xs"))  # 400 numbers
    # the first point not below a key is at most one place off the logarithm's
    at = F.floor(F.log(F.col("v") / low) / (np.log(high / low) / 399)).cast("int")
    near = F.filter(F.sequence(F.greatest(at - 1, F.lit(0)), F.least(at + 2, F.lit(399))), lambda k: F.col("xs")[k] >= F.col("v"))
    first = keys.crossJoin(F.broadcast(grid)).select(F.get(near, F.lit(0)).cast("long").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("c"))
    return g.join(F.broadcast(first), "i", "left").select("i", "x", F.coalesce(F.sum("c").over(Window.orderBy("i")), F.lit(0)).alias("n"))


@query("SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS first_number, TRY_CAST(o_orderpriority AS DOUBLE) AS whole FROM orders")
def try_cast_numeric(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr("try_cast(substr(o_orderpriority, 1, 1) AS double) AS first_number"), F.expr("try_cast(o_orderpriority AS double) AS whole"))


@query("SELECT event_id, round(value, 6) AS value FROM events WHERE value IS NOT NULL AND isfinite(value)")
def filter_finite(spark, d):
    return table(spark, d, "events").where(clean.finite("value")).select("event_id", F.round("value", 6).alias("value"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def filter_eq(spark, d):
    return table(spark, d, "events").where(F.col("event_type") == "click").select("event_id", "user_id")


@query(f"WITH {RUNS} SELECT method_id, seed, round(mae, 6) AS mae FROM runs WHERE split = 'random' AND train_size = 1996")
def filter_conj_lookup(spark, d):
    return runs(spark, d).where("split = 'random' AND train_size = 1996").select("method_id", "seed", *r6("mae"))


@query("SELECT text AS key, count(DISTINCT source) AS n_values FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1")
def having_conflicts(spark, d):
    return clean.conflicts(table(spark, d, "documents").select(F.col("text").alias("key"), "source"), "key", "source")


@query("SELECT min(doc_id) AS doc_id, min(source) AS source FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT source) = 1")
def dedup_conflict_drop(spark, d):
    return clean.drop_conflicts(table(spark, d, "documents").select("doc_id", "text", "source"), "text", "source", "doc_id").select("doc_id", "source")


@query("""WITH raw AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS original_row_index, p_brand || '|' || p_name AS key,
  CASE WHEN p_partkey % 11 = 0 THEN 'n/a' WHEN p_partkey % 13 = 0 THEN 'inf' WHEN p_partkey % 17 = 0 THEN '' ELSE (p_size % 2) || '.12345678901' END AS t FROM part),
 num AS (SELECT original_row_index, key, round_even(TRY_CAST(t AS DOUBLE), 10) AS value FROM raw WHERE isfinite(TRY_CAST(t AS DOUBLE))),
 one AS (SELECT key, min(value) AS value, min(original_row_index) AS original_row_index FROM num GROUP BY key HAVING count(DISTINCT value) = 1)
 SELECT row_number() OVER (ORDER BY md5(key), key) - 1 AS mol_id, original_row_index, key, round(value, 10) AS value, key || '||' || printf('%.10f', value) AS molecular_target_key FROM one""")
def clean_chain(spark, d):
    """Raw rows with their index, text to finite numbers of ten decimals, keys that agree, first row of each, dense ids."""
    t = F.when(F.col("p_partkey") % 11 == 0, "n/a").when(F.col("p_partkey") % 13 == 0, "inf").when(F.col("p_partkey") % 17 == 0, "").otherwise(F.concat((F.col("p_size") % 2).cast("string"), F.lit(".12345678901")))
    raw = dense_id(table(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_name").alias("key"), t.alias("value")), "p_partkey", name="original_row_index")
    kept = clean.drop_conflicts(clean.coerce(raw, "value").select("original_row_index", "key", "value"), "key", "value", "original_row_index")
    rows = dense_id(kept.withColumn("h", F.md5("key")), "h", "key", name="mol_id")
    return rows.select("mol_id", "original_row_index", "key", "value", target_key(F.col("key"), F.col("value")).alias("molecular_target_key"))


@query("SELECT row_number() OVER (ORDER BY md5(text), doc_id) - 1 AS mol_id, doc_id FROM documents")
def dense_surrogate_id(spark, d):
    rows = table(spark, d, "documents").select(F.md5("text").alias("h"), "doc_id")
    return dense_id(rows, "h", "doc_id", name="mol_id").select("mol_id", "doc_id")


@query("SELECT doc_id, md5(lower(trim(source))) AS key FROM documents")
def udf_apply_text_key(spark, d):
    plain = normaliser(lambda s: s.strip().lower())
    return table(spark, d, "documents").select("doc_id", F.md5(plain("source")).alias("key"))


@query("SELECT doc_id, source AS can, lower(source) AS ik, left(lower(source), 3) AS ik_ns FROM documents")
def udf_struct_unpack(spark, d):
    parts = key_parts(lambda s: (s, s.lower(), s.lower()[:3]))
    return table(spark, d, "documents").select("doc_id", parts("source").alias("k")).select("doc_id", "k.can", "k.ik", "k.ik_ns")


@query("SELECT p_partkey, p_name || '||' || printf('%.10f', p_retailprice) AS molecular_target_key FROM part")
def string_key_concat(spark, d):
    return table(spark, d, "part").select("p_partkey", target_key(F.col("p_name"), F.col("p_retailprice")).alias("molecular_target_key"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 10 THEN p_name END, 'NO_SCAFFOLD::' || p_brand) AS grp FROM part")
def sentinel_fallback(spark, d):
    return table(spark, d, "part").select("p_partkey", sentinel(F.when(F.col("p_size") > 10, F.col("p_name")), F.col("p_brand"), "NO_SCAFFOLD::").alias("grp"))


@query("SELECT p_partkey, CAST(round_even(p_size / 2.0, 0) AS BIGINT) AS half FROM part")
def bround_half_even(spark, d):
    return table(spark, d, "part").select("p_partkey", F.bround(F.col("p_size") / 2.0, 0).cast("long").alias("half"))


@query("SELECT p_partkey, p_size || '-' || (p_size + 1) AS pair, printf('%.3f', p_retailprice) AS price, CAST(p_size // 10 AS VARCHAR) || 'k' AS size_k, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS name FROM part")
def format_labels(spark, d):
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.lower(F.expr("substr(p_name, 2)")))
    return table(spark, d, "part").select("p_partkey", F.format_string("%d-%d", "p_size", F.col("p_size") + 1).alias("pair"), F.format_string("%.3f", "p_retailprice").alias("price"), F.concat(F.floor(F.col("p_size") / 10).cast("string"), F.lit("k")).alias("size_k"), name.alias("name"))


# --- groups and splits ---


@query("SELECT p_name, count(*) AS size, min(p_partkey) AS first_id, max(p_partkey) AS last_id FROM part GROUP BY 1")
def scaffold_groups(spark, d):
    return splits.groups(table(spark, d, "part"), "p_name", "p_partkey")


@query("SELECT p_name, p_partkey, count(*) OVER (PARTITION BY p_name) AS size FROM part")
def scaffold_members(spark, d):
    return splits.group_members(table(spark, d, "part"), "p_name", "p_partkey")


@query("SELECT p_name, count(*) AS size FROM part GROUP BY 1 ORDER BY size DESC, p_name LIMIT 30")
def top_scaffolds(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "p_name").limit(30)


SPLIT = """n AS (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) AS nt, CAST(floor(count(*) * 0.1) AS BIGINT) AS nv FROM customer),
 s AS (SELECT seed, c_custkey, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || c_custkey), c_custkey) AS rn FROM customer, (VALUES (11), (22), (33)) v(seed)),
 sp AS (SELECT seed, c_custkey, rn - nt - nv AS pos, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + nv THEN 'val' ELSE 'train' END AS split_role FROM s, n)"""


@query(f"WITH {SPLIT} SELECT * FROM sp")
def split_random(spark, d):
    return splits.random_split(table(spark, d, "customer"), "c_custkey", [11, 22, 33])


@query(f"WITH {SPLIT} SELECT seed, c_custkey, z AS target_train_size FROM sp JOIN (VALUES (10), (50), (100), (500)) v(z) ON pos <= z WHERE split_role = 'train'")
def nested_train_prefixes(spark, d):
    pool = splits.random_split(table(spark, d, "customer"), "c_custkey", [11, 22, 33])
    return splits.nested_prefixes(pool, [10, 50, 100, 500]).select("seed", "c_custkey", "target_train_size")


GROUP_SPLIT = """g AS (SELECT p_name, count(*) AS size FROM part GROUP BY 1),
 a AS (SELECT *, coalesce(sum(size) OVER (ORDER BY size DESC, md5('11|' || p_name), p_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < (SELECT count(*) * 2 // 3 FROM part) AS train FROM g),
 b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY train ORDER BY md5('12|' || p_name), p_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM a),
 gs AS (SELECT p_name, size, CASE WHEN train THEN 'train' WHEN seen < CAST(round_even((SELECT sum(size) FROM a WHERE NOT train) / 3.0, 0) AS BIGINT) THEN 'val' ELSE 'test' END AS split_role FROM b)"""


def _group_split(spark, d):
    part = table(spark, d, "part")
    sizes = part.groupBy("p_name").agg(F.count(F.lit(1)).alias("size"))
    return splits.group_split(sizes, "p_name", 11, part.count() * 2 // 3)


@query(f"WITH {GROUP_SPLIT} SELECT p_partkey, split_role FROM part JOIN gs USING (p_name)")
def split_scaffold(spark, d):
    return table(spark, d, "part").join(_group_split(spark, d), "p_name").select("p_partkey", "split_role")


@query(f"WITH {GROUP_SPLIT}, pool AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('11|' || p_partkey), p_partkey) AS pos FROM part JOIN gs USING (p_name) WHERE split_role = 'train') SELECT p_partkey, pos, z AS target_train_size FROM pool JOIN (VALUES (10), (50), (100), (500), (1000), (2000), (5000), (10000)) v(z) ON pos <= z")
def nested_group_prefixes(spark, d):
    """Members of the training groups, shuffled, once for each of eight sizes whose prefix holds them."""
    pool = splits.group_pool(table(spark, d, "part"), _group_split(spark, d), "p_name", "p_partkey", 11)
    return splits.nested_prefixes(pool, [10, 50, 100, 500, 1000, 2000, 5000, 10_000]).select("p_partkey", "pos", "target_train_size")


@query(f"WITH {SPLIT}, {GROUP_SPLIT} SELECT 'random' AS split, seed, split_role, count(*) AS n FROM sp GROUP BY 2, 3 UNION ALL SELECT 'scaffold', 11, split_role, CAST(sum(size) AS BIGINT) FROM gs GROUP BY 3")
def split_diagnostics(spark, d):
    """Rows of each role, of the random and of the group split."""
    one = split_random(spark, d).groupBy("seed", "split_role").agg(F.count(F.lit(1)).alias("n")).select(F.lit("random").alias("split"), "seed", "split_role", "n")
    two = _group_split(spark, d).groupBy("split_role").agg(F.sum("size").alias("n")).select(F.lit("scaffold").alias("split"), F.lit(11).alias("seed"), "split_role", "n")
    return one.unionByName(two)


@query(f"WITH {SPLIT} SELECT 'roles' AS panel, seed, split_role, count(*) AS n, NULL AS scaffold FROM sp GROUP BY 2, 3 UNION ALL SELECT * FROM (SELECT 'scaffolds', NULL, NULL, count(*) AS c, p_name FROM part GROUP BY p_name ORDER BY c DESC, p_name LIMIT 30)")
def panel_union(spark, d):
    roles = split_random(spark, d).groupBy("seed", "split_role").agg(F.count(F.lit(1)).alias("n")).withColumn("panel", F.lit("roles"))
    top = top_scaffolds(spark, d).select(F.lit("scaffolds").alias("panel"), F.col("size").alias("n"), F.col("p_name").alias("scaffold"))
    return roles.unionByName(top, allowMissingColumns=True)


@query("SELECT c_nationkey, round(avg(c_acctbal), 6) AS mean, count(*) AS n, round(max(c_acctbal) - min(c_acctbal), 6) AS spread FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1")
def collapse_stats(spark, d):
    return table(spark, d, "customer").dropna(subset=["c_nationkey"]).groupBy("c_nationkey").agg(*[F.round(c, 6).alias(k) for k, c in (("mean", F.avg("c_acctbal")), ("spread", F.max("c_acctbal") - F.min("c_acctbal")))], F.count(F.lit(1)).alias("n"))


@query("SELECT s_nationkey, round(avg(s_acctbal), 6) AS mean, count(*) AS n, sum(CAST(s_suppkey AS BIGINT))::BIGINT AS total, max(s_suppkey) AS last, min_by(s_name, s_suppkey) AS first_name FROM supplier GROUP BY 1")
def collapse_multi_agg(spark, d):
    return table(spark, d, "supplier").where("s_nationkey IS NOT NULL").groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal"), 6).alias("mean"), F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("total"), F.max("s_suppkey").alias("last"), F.expr("min_by(s_name, s_suppkey) FILTER (WHERE s_name IS NOT NULL)").alias("first_name"))


@query(f"WITH {PAIRS} SELECT k, round(x, 6) AS x, round(y, 6) AS y, n, n_y FROM pairs")
def label_fidelity_match(spark, d):
    return pairs(spark, d).select("k", *r6("x", "y"), "n", "n_y")


@query("""WITH c AS (SELECT 'nation' AS level, c_nationkey AS key, c_acctbal AS v FROM customer UNION ALL SELECT 'region', n_regionkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
 s AS (SELECT 'nation' AS level, s_nationkey AS key, s_acctbal AS v FROM supplier UNION ALL SELECT 'region', n_regionkey, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey)
 SELECT level, count(*) AS matched, CAST(sum(CASE WHEN n > m THEN 1 ELSE 0 END) AS BIGINT) AS more_left FROM (SELECT level, key, count(*) AS n FROM c GROUP BY 1, 2) JOIN (SELECT level, key, count(*) AS m FROM s GROUP BY 1, 2) USING (level, key) GROUP BY 1""")
def match_levels(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")

    def stacked(name: str, key: str, n: str) -> DataFrame:
        per = table(spark, d, name).groupBy(key).agg(F.count(F.lit(1)).alias("c")).join(nation, F.col(key) == F.col("n_nationkey"))
        levels = F.explode(F.array(F.struct(F.lit("nation").alias("level"), F.col(key).alias("key")), F.struct(F.lit("region").alias("level"), F.col("n_regionkey").alias("key"))))
        return per.select(levels.alias("l"), "c").groupBy("l.level", "l.key").agg(F.sum("c").alias(n))

    both = stacked("customer", "c_nationkey", "n").join(stacked("supplier", "s_nationkey", "m"), ["level", "key"])
    return both.groupBy("level").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("n") > F.col("m")).alias("more_left"))


@query("""WITH k AS (SELECT doc_id % 2 = 0 AS a, unnest(['exact', 'folded', 'prefix']) AS level, unnest([md5(text), md5(lower(text)), md5(left(lower(text), 40))]) AS key FROM documents WHERE text IS NOT NULL),
 g AS (SELECT level, key, count(*) FILTER (WHERE a) AS n, count(*) FILTER (WHERE NOT a) AS m FROM k GROUP BY 1, 2)
 SELECT level, count(*) FILTER (WHERE n > 0 AND m > 0) AS n_matched, count(*) FILTER (WHERE n > 1) AS collapsed, count(*) FILTER (WHERE n > 1 AND m > 0) AS matched_with_collapsed FROM g GROUP BY 1""")
def match_three_keys(spark, d):
    """Two sides matched at three key levels by one shuffle: how many keys match, and how many stand for several rows."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    keys = {"exact": F.col("text"), "folded": F.lower("text"), "prefix": F.substring(F.lower("text"), 1, 40)}
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.md5(c).alias("key")) for k, c in keys.items()]))
    rows = docs.select((F.col("doc_id") % 2 == 0).alias("a"), levels.alias("x")).select("a", "x.*")
    per = rows.groupBy("level", "key").agg(F.count_if("a").alias("n"), F.count_if(~F.col("a")).alias("m"))
    both, many = (F.col("n") > 0) & (F.col("m") > 0), F.col("n") > 1
    return per.groupBy("level").agg(F.count_if(both).alias("n_matched"), F.count_if(many).alias("collapsed"), F.count_if(many & both).alias("matched_with_collapsed"))


@query(f"WITH {PAIRS} SELECT k, round(x + (0.241 - 0.197), 6) AS shifted, round(y - (x + (0.241 - 0.197)), 6) AS diff FROM pairs")
def label_fidelity_pairs(spark, d):
    return pairs(spark, d).withColumns({"shifted": F.col("x") + (0.241 - 0.197)}).select("k", *r6("shifted", diff=F.col("y") - F.col("shifted")))


@query("SELECT l_returnflag, count(*) AS n, round(avg(abs(l_discount - l_tax)), 6) AS mae, round(sqrt(avg((l_discount - l_tax) ** 2)), 6) AS rmse, round(avg(l_discount - l_tax), 6) AS mean_signed FROM lineitem GROUP BY 1")
def error_metrics(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*stats.error_metrics(F.col("l_tax"), F.col("l_discount")))
    return out.select("l_returnflag", "n", *r6("mae", "rmse", "mean_signed"))


@query(f"WITH {PAIRS} SELECT round(corr(x, y), 6) AS r, round(corr(x, y) ** 2, 6) AS r2, count(*) AS n FROM pairs")
def pearson_r2(spark, d):
    return pairs(spark, d).agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n")).select(*r6("r", r2=F.col("r") * F.col("r")), "n")


@query(f"WITH {PAIRS}, f AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM pairs) SELECT k, round(slope * x + intercept, 4) AS pred, round(slope, 6) AS slope FROM pairs, f")
def linear_recalibration(spark, d):
    p = pairs(spark, d)
    f = p.agg(*stats.line_fit("y", "x"))
    return p.crossJoin(F.broadcast(f)).select("k", F.round(F.col("slope") * F.col("x") + F.col("intercept"), 4).alias("pred"), F.round("slope", 6).alias("slope"))


LOO = "SELECT a.k, round(regr_slope(b.y, b.x) * any_value(a.x) + regr_intercept(b.y, b.x), 4) AS loo FROM {t} a JOIN {t} b ON a.k <> b.k GROUP BY a.k"


@query(f"WITH {PAIRS} " + LOO.format(t="pairs"))
def loo_recalibration(spark, d):
    return stats.leave_one_out(pairs(spark, d), "y", "x").select("k", F.round("loo", 4).alias("loo"))


@query("WITH u AS (SELECT o_orderkey AS k, o_totalprice / 1000 AS x, max(l_quantity) AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(*) = 1) " + LOO.format(t="u"))
def loo_uncollapsed(spark, d):
    """Leave-one-out over the pairs that no averaging has collapsed: orders of a single line."""
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_quantity").alias("y"), F.count(F.lit(1)).alias("n")).where("n = 1")
    u = line.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1000).alias("x")), "k")
    return stats.leave_one_out(u, "y", "x").select("k", F.round("loo", 4).alias("loo"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS med, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS over_half FROM events GROUP BY 1")
def replicate_stats(spark, d):
    events = table(spark, d, "events")
    per = events.groupBy("event_type").agg(*[F.round(c, 6).alias(k) for k, c in (("mean", F.avg("value")), ("over_half", F.avg((F.col("value") > 50).cast("double"))))])
    med = exact_quantiles(events, "value", [0.5], "event_type").select(F.col("event_type").alias("of"), F.round(F.col("q")[0], 6).alias("med"))
    return per.join(med, F.col("event_type").eqNullSafe(F.col("of"))).drop("of")


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS n_null, count(*) FILTER (WHERE n_chars > doc_id) AS longer FROM documents GROUP BY 1")
def conditional_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull()).alias("n_null"), F.count_if(F.col("n_chars") > F.col("doc_id")).alias("longer"))


DRAWS = f"""{PAIRS}, num AS (SELECT row_number() OVER (ORDER BY k) - 1 AS r, abs(y - x) AS e FROM pairs),
 draws AS (SELECT draw, slot, CAST(('0x' || substr(md5(draw || '|' || slot), 1, 8)) AS BIGINT) % (SELECT count(*) FROM num) AS pick FROM range(20000) a(draw), (SELECT unnest(range(count(*))) AS slot FROM num)),
 means AS (SELECT draw, avg(e) AS m FROM draws JOIN num ON pick = r GROUP BY 1)"""


def _boot(spark, d):
    num = dense_id(pairs(spark, d).select("k", F.abs(F.col("y") - F.col("x")).alias("e")), "k", name="row")
    return stats.hash_draws(num, 20_000).join(num, F.col("pick") == F.col("row")).groupBy("draw").agg(F.avg("e").alias("m"))


@query(f"WITH {DRAWS} SELECT draw, round(m, 4) AS m FROM means")
def bootstrap_mean(spark, d):
    return _boot(spark, d).select("draw", F.round("m", 4).alias("m"))


@query(f"WITH {DRAWS} SELECT round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi FROM means")
def bootstrap_quantiles(spark, d):
    q = exact_quantiles(checkpointed(_boot(spark, d)), "m", [0.025, 0.975])
    return q.select(F.round(F.col("q")[0], 4).alias("lo"), F.round(F.col("q")[1], 4).alias("hi"))


# --- ranking ---


@query(f"WITH {SUMM} SELECT split, train_size, method_id, n_seeds, round(mean_mae, 6) AS mean_mae, round(std_mae, 6) AS std_mae, round(mean_rmse, 6) AS mean_rmse, round(std_rmse, 6) AS std_rmse, round(mean_r2, 6) AS mean_r2, round(std_r2, 6) AS std_r2 FROM summ")
def summary_by_condition(spark, d):
    return ranking.summary(runs(spark, d)).select("split", "train_size", "method_id", "n_seeds", *r6("mean_mae", "std_mae", "mean_rmse", "std_rmse", "mean_r2", "std_r2"))


def _ranked(spark, d):
    return ranking.ranked(ranking.summary(runs(spark, d)))


def _tests(spark, d):
    return ranking.seed_pairs(runs(spark, d)).groupBy(*ranking.CELL, "m1", "m2").agg(*stats.paired_test("d"))


@query(f"WITH {SUMM} SELECT split, train_size, method_id, rnk, round(mean_mae, 6) AS mean_mae FROM ranked")
def rank_by_mean_mae(spark, d):
    return _ranked(spark, d).select("split", "train_size", "method_id", "rnk", *r6("mean_mae"))


@query("SELECT p_brand, p_size, CAST(floor(rank() OVER (PARTITION BY p_brand ORDER BY n) + (count(*) OVER (PARTITION BY p_brand, n) - 1) / 2.0) AS BIGINT) AS rnk FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2)")
def average_rank(spark, d):
    n = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    avg = F.rank().over(Window.partitionBy("p_brand").orderBy("n")) + (F.count(F.lit(1)).over(Window.partitionBy("p_brand", "n")) - 1) / 2.0
    return n.select("p_brand", "p_size", F.floor(avg).cast("long").alias("rnk"))


_YEARS = range(1995, 2002)


@query(f"WITH {SUMM} SELECT split, method_id, " + ", ".join(f"max(CASE WHEN train_size = {y} THEN rnk END) AS rank_{y}, round(max(CASE WHEN train_size = {y} THEN mean_mae END), 6) AS mean_mae_{y}" for y in _YEARS) + " FROM ranked GROUP BY 1, 2")
def rank_matrix_pivot(spark, d):
    p = _ranked(spark, d).groupBy("split", "method_id").pivot("train_size", list(_YEARS)).agg(F.max("rnk").alias("rank"), F.round(F.max("mean_mae"), 6).alias("mean_mae"))
    return p.withColumnsRenamed({f"{y}_{k}": f"{k}_{y}" for y in _YEARS for k in ("rank", "mean_mae")})


@query(f"WITH {RUNS} SELECT split, method_id, train_size, " + ", ".join(f"round(avg(CASE WHEN seed = {s} THEN mae END), 6) AS seed_{s}" for s in (11, 22, 33, 44, 55)) + " FROM runs GROUP BY 1, 2, 3")
def pivot_seed_matrix(spark, d):
    p = runs(spark, d).groupBy("split", "method_id", "train_size").pivot("seed", [11, 22, 33, 44, 55]).agg(F.round(F.avg("mae"), 6))
    return p.withColumnsRenamed({str(s): f"seed_{s}" for s in (11, 22, 33, 44, 55)})


@query(f"WITH {SUMM} SELECT split, train_size, method_id AS best, round(mean_mae, 6) AS mean_mae FROM ranked WHERE rnk = 1")
def best_model_per_size(spark, d):
    best = ranking.summary(runs(spark, d)).groupBy("split", "train_size").agg(F.min(F.struct("mean_mae", "method_id")).alias("b"))
    return best.select("split", "train_size", F.col("b.method_id").alias("best"), F.round("b.mean_mae", 6).alias("mean_mae"))


@query(f"WITH {SUMM} SELECT split, train_size, round(max(CASE WHEN rnk = 3 THEN mean_mae END) - max(CASE WHEN rnk = 1 THEN mean_mae END), 6) AS spread FROM ranked GROUP BY 1, 2")
def top3_spread(spark, d):
    at = lambda k: F.max(F.when(F.col("rnk") == k, F.col("mean_mae")))
    return _ranked(spark, d).groupBy("split", "train_size").agg(F.round(at(3) - at(1), 6).alias("spread"))


@query(f"WITH {SUMM} SELECT method_id, train_size, round(max(CASE WHEN split = 'random' THEN mean_mae END), 6) AS random_mae, round(max(CASE WHEN split = 'scaffold' THEN mean_mae END), 6) AS scaffold_mae, round(max(CASE WHEN split = 'scaffold' THEN mean_mae END) - max(CASE WHEN split = 'random' THEN mean_mae END), 6) AS gap FROM summ GROUP BY 1, 2")
def generalization_gap(spark, d):
    p = ranking.summary(runs(spark, d)).groupBy("method_id", "train_size").pivot("split", ["random", "scaffold"]).agg(F.max("mean_mae"))
    return p.select("method_id", "train_size", *r6(random_mae=F.col("random"), scaffold_mae=F.col("scaffold"), gap=F.col("scaffold") - F.col("random")))


#: A label and a family for each method.
METHODS = [("AUTOMOBILE", "Automobile", "goods"), ("BUILDING", "Building", "works"), ("FURNITURE", "Furniture", "goods"), ("HOUSEHOLD", "Household", "goods"), ("MACHINERY", "Machinery", "works")]


@query(f"WITH {SUMM} SELECT s.method_id, any_value(label) AS method_label, any_value(family) AS family, train_size, " + ", ".join(f"round(max({k}_mae) FILTER (WHERE split = '{x}'), 6) AS {k}_mae_{x}" for k in ("mean", "std") for x in ("random", "scaffold")) + ", round(max(mean_mae) FILTER (WHERE split = 'scaffold') - max(mean_mae) FILTER (WHERE split = 'random'), 6) AS gap FROM summ s LEFT JOIN (VALUES " + ", ".join(map(str, METHODS)) + ") v(method_id, label, family) ON s.method_id = v.method_id GROUP BY s.method_id, train_size")
def gap_table(spark, d):
    """The gap between the splits with means and deviations of both, methods labelled by a lookup (its size is written in the code)."""
    p = ranking.summary(runs(spark, d)).groupBy("method_id", "train_size").pivot("split", ["random", "scaffold"]).agg(F.max("mean_mae").alias("mean_mae"), F.max("std_mae").alias("std_mae"))
    p = p.join(F.broadcast(constants(spark, METHODS, "method_id string, method_label string, family string")), "method_id", "left")
    means = {f"{k}_mae_{x}": F.col(f"{x}_{k}_mae") for k in ("mean", "std") for x in ("random", "scaffold")}
    return p.select("method_id", "method_label", "family", "train_size", *r6(**means, gap=F.col("scaffold_mean_mae") - F.col("random_mean_mae")))


@query(f"WITH {TESTS} SELECT DISTINCT split, train_size, m1, m2 FROM sp")
def method_pairs_theta(spark, d):
    return ranking.seed_pairs(runs(spark, d)).select("split", "train_size", "m1", "m2").distinct()


@query(f"WITH {TESTS} SELECT split, train_size, seed, m1, m2, round(d, 6) AS d FROM sp")
def pairwise_seed_diff(spark, d):
    return ranking.seed_pairs(runs(spark, d)).select("split", "train_size", "seed", "m1", "m2", *r6("d"))


@query(f"WITH {TESTS} SELECT split, train_size, m1, m2, round(mean_diff, 6) AS mean_diff, round(p, 6) AS p, agree FROM tests")
def paired_ttest(spark, d):
    return _tests(spark, d).select("split", "train_size", "m1", "m2", *r6("mean_diff", "p"), "agree")


def _adjacent(spark, d):
    return ranking.adjacent_tests(ranking.standings(runs(spark, d)))


@query(f"WITH {ADJ} SELECT split, train_size, rank_pair, better, worse, round(abs_diff, 6) AS abs_diff, round(p, 6) AS p, agree, resolved, abs_diff < 0.0005 AS below FROM adj")
def rank_resolution_adjacent(spark, d):
    a = _adjacent(spark, d).withColumn("abs_diff", F.abs("mean_diff"))
    return a.select("split", "train_size", "rank_pair", "better", "worse", *r6("abs_diff", "p"), "agree", "resolved", (F.col("abs_diff") < 0.0005).alias("below"))


def _top(spark, d):
    return ranking.top_of(ranking.standings(runs(spark, d)))


@query(f"WITH {TOP} SELECT t.split, t.train_size, rank1, CAST(top_size AS INTEGER) AS top_size, round(best_mae, 6) AS best_mae, rank1 || coalesce((SELECT ',' || string_agg(r.method_id, ',' ORDER BY r.rnk) FROM both_ways b JOIN ranked r ON r.split = b.split AND r.train_size = b.train_size AND r.method_id = b.m2 WHERE b.split = t.split AND b.train_size = t.train_size AND b.m1 = t.rank1 AND NOT b.resolved), '') AS members FROM top t")
def top_groups(spark, d):
    return _top(spark, d).select("split", "train_size", "rank1", F.size("top_group").alias("top_size"), *r6("best_mae"), F.array_join("top_group", ",").alias("members"))


@query(f"WITH {TOP} SELECT r.split, r.train_size, r.method_id, CASE WHEN r.rnk = 1 AND top_size = 1 THEN 'unique' WHEN r.rnk = 1 OR EXISTS (SELECT 1 FROM both_ways b WHERE b.split = r.split AND b.train_size = r.train_size AND b.m1 = t.rank1 AND b.m2 = r.method_id AND NOT b.resolved) THEN 'top' ELSE 'rest' END AS shade FROM ranked r JOIN top t ON r.split = t.split AND r.train_size = t.train_size")
def top_group_heatmap(spark, d):
    rows = _ranked(spark, d).join(_top(spark, d), ["split", "train_size"])
    held = F.array_contains("top_group", F.col("method_id"))
    return rows.select("split", "train_size", "method_id", F.when(held & (F.size("top_group") == 1), "unique").when(held, "top").otherwise("rest").alias("shade"))


@query(f"WITH {ADJ}, {TOP[len(TESTS) + 2:]} SELECT (SELECT count(*) FROM adj) AS pairs, (SELECT count(*) FROM adj WHERE resolved) AS n_resolved, (SELECT count(*) FROM top) AS cells, (SELECT count(*) FROM top WHERE top_size = 1) AS unique_winner, (SELECT round(avg(top_size), 6) FROM top) AS mean_size")
def resolution_summary(spark, d):
    a = _adjacent(spark, d).agg(F.count(F.lit(1)).alias("pairs"), F.count_if("resolved").alias("n_resolved"))
    t = _top(spark, d).agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.size("top_group") == 1).alias("unique_winner"), F.round(F.avg(F.size("top_group")), 6).alias("mean_size"))
    return a.crossJoin(t)


@query(f"WITH {TESTS} SELECT split, m1, m2, string_agg(train_size || ':' || printf('%.5f', mean_diff), ',' ORDER BY train_size) AS diffs FROM tests GROUP BY 1, 2, 3")
def paired_diff_map(spark, d):
    m = _tests(spark, d).groupBy("split", "m1", "m2").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("train_size", "mean_diff")))).alias("m"))
    return m.select("split", "m1", "m2", F.expr("array_join(transform(map_entries(m), e -> format_string('%d:%.5f', e.key, e.value)), ',')").alias("diffs"))


@query(f"WITH {TESTS} SELECT split, train_size, m1, m2, count(*) FILTER (WHERE d < 0) AS better FROM sp GROUP BY 1, 2, 3, 4")
def seeds_better_by_size(spark, d):
    return ranking.seed_pairs(runs(spark, d)).groupBy("split", "train_size", "m1", "m2").agg(F.count_if(F.col("d") < 0).alias("better"))


@query("SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS label FROM orders GROUP BY 1")
def label_lookup(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("label"))


@query(f"WITH {RUNS} SELECT DISTINCT train_size FROM runs")
def distinct_sorted(spark, d):
    return runs(spark, d).select("train_size").distinct().orderBy("train_size")


@query(f"WITH {RUNS} SELECT s.split, y.train_size, count(r.mae) AS held FROM (VALUES ('random'), ('scaffold')) s(split) CROSS JOIN (SELECT CAST(unnest(range(1995, 2002)) AS INTEGER) AS train_size) y LEFT JOIN runs r ON r.split = s.split AND r.train_size = y.train_size GROUP BY 1, 2")
def grid_completeness(spark, d):
    grid = constants(spark, [(s, y) for s in ("random", "scaffold") for y in _YEARS], "split string, train_size int")
    return F.broadcast(grid).join(runs(spark, d), ["split", "train_size"], "left").groupBy("split", "train_size").agg(F.count("mae").alias("held"))


# --- curves ---


@query(f"WITH {RUNS} SELECT split, train_size, method_id, seed, round(mae * pow(train_size - 1994, -0.3) + 0.05, 6) AS fit FROM runs")
def powerlaw_predict(spark, d):
    return runs(spark, d).select("split", "train_size", "method_id", "seed", F.round(curves.predict(F.col("train_size") - 1994, F.col("mae"), F.lit(0.3), F.lit(0.05)), 6).alias("fit"))


@query(f"""WITH {SUMM}, pts AS (SELECT split, method_id, (train_size - 1994) AS n, mean_mae AS y FROM summ), grid AS (SELECT 0.01 + i * (1.99 / 399) AS b FROM range(400) r(i)),
 f AS (SELECT split, method_id, b, regr_intercept(y, pow(n, -b)) AS c0, min(y) AS low, sum(pow(n, -b) * y) AS zy, sum(pow(n, -b)) AS sz, sum(pow(n, -b) * pow(n, -b)) AS zz, sum(y * y) AS yy, sum(y) AS sy, count(*) AS m FROM pts, grid GROUP BY 1, 2, 3),
 g AS (SELECT *, least(greatest(c0, 0.0), low) AS c FROM f), h AS (SELECT *, greatest((zy - c * sz) / zz, 0.0) AS a FROM g),
 k AS (SELECT *, yy + a*a*zz + m*c*c - 2*a*zy - 2*c*sy + 2*a*c*sz AS ssr FROM h)
 SELECT split, method_id, round(min(ssr), 8) AS ssr FROM k GROUP BY 1, 2""")
def powerlaw_fit_grid(spark, d):
    return curves.fit_grid(_points(runs(spark, d)), "split", "method_id").select("split", "method_id", F.round("ssr", 8).alias("ssr"))


CROSS = """g AS (SELECT i, 500 * pow(20.0, i / 3999.0) AS x FROM range(4000) r(i)),
 cv AS (SELECT c_nationkey AS k, 1 + avg(c_acctbal) / 5000 AS a2 FROM customer GROUP BY 1),
 s AS (SELECT k, i, x, sign(1.1 * pow(x, -0.31) - (a2 * pow(x, -0.28) + 0.02)) AS s FROM cv, g),
 n AS (SELECT *, lead(s) OVER (PARTITION BY k ORDER BY i) AS nx FROM s)"""


@query(f"WITH {CROSS} SELECT k, round(min(CASE WHEN s <> nx THEN x END), 4) AS crossover FROM n GROUP BY 1")
def crossover_grid(spark, d):
    cv = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((1 + F.avg("c_acctbal") / 5000).alias("a2"))
    lits = {"a1": 1.1, "b1": 0.31, "c1": 0.0, "b2": 0.28, "c2": 0.02}
    return curves.crossover(cv.withColumns({k: F.lit(v) for k, v in lits.items()}), "k").select("k", F.round("crossover", 4).alias("crossover"))


def _boot_curves(runs, draws: int = 2000):
    """(split, method_id, draw, n, y): for each size five seeds drawn with replacement, by md5, and averaged."""
    seeds = runs.groupBy("split", "method_id", "train_size").agg(F.transform(F.sort_array(F.collect_list(F.struct("seed", "mae"))), lambda x: x["mae"]).alias("v"))
    drawn = seeds.select("split", "method_id", "train_size", "v", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    pick = "aggregate(sequence(0, size(v) - 1), 0D, (s, i) -> s + v[cast(conv(substring(md5(concat_ws('|', split, method_id, train_size, draw, i)), 1, 8), 16, 10) AS bigint) % size(v)]) / size(v)"
    return drawn.select("split", "method_id", "draw", (F.col("train_size") - 1994).alias("n"), F.expr(pick).alias("y"))


BOOT = f"""{RUNS}, num AS (SELECT *, row_number() OVER (PARTITION BY split, method_id, train_size ORDER BY seed) - 1 AS r, count(*) OVER (PARTITION BY split, method_id, train_size) AS c FROM runs),
 dr AS (SELECT split, method_id, train_size, draw, r AS i, CAST(('0x' || substr(md5(split || '|' || method_id || '|' || train_size || '|' || draw || '|' || r), 1, 8)) AS BIGINT) % c AS pick FROM num, range(2000) q(draw)),
 boot AS (SELECT dr.split, dr.method_id, dr.draw, dr.train_size, avg(num.mae) AS y FROM dr JOIN num ON num.split = dr.split AND num.method_id = dr.method_id AND num.train_size = dr.train_size AND num.r = dr.pick GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {BOOT} SELECT split, method_id, CAST(draw AS INTEGER) AS draw, train_size - 1994 AS n, round(y, 6) AS y FROM boot")
def bootstrap_curve(spark, d):
    return _boot_curves(runs(spark, d)).select("split", "method_id", "draw", "n", *r6("y"))


#: Pairs of methods whose curves are compared.
CROSSING = [("AUTOMOBILE", "BUILDING"), ("AUTOMOBILE", "FURNITURE"), ("AUTOMOBILE", "HOUSEHOLD"), ("BUILDING", "MACHINERY")]


def _points(runs):
    return ranking.summary(runs).select("split", "method_id", (F.col("train_size") - 1994).alias("n"), F.col("mean_mae").alias("y"))


def _fits_sql(points: str, keys: str, name: str, rounds: int = 6) -> str:
    """CTEs of the refined fits ``name`` (keys, a, b, c) of a relation (keys, n, y): the grid over b, then finer ones around the best."""
    best = f"""(SELECT {keys}, unnest(arg_min(struct_pack(a := a, b := b, c := c), (round(yy + a*a*zz + m*c*c - 2*a*zy - 2*c*sy + 2*a*c*sz, 12), b))) FROM (SELECT *, greatest((zy - c * sz) / zz, 0.0) AS a FROM (SELECT *, least(greatest(c0, 0.0), low) AS c FROM
  (SELECT {keys}, b, regr_intercept(y, pow(n, -b)) AS c0, min(y) AS low, sum(pow(n, -b) * y) AS zy, sum(pow(n, -b)) AS sz, sum(pow(n, -b) * pow(n, -b)) AS zz, sum(y * y) AS yy, sum(y) AS sy, count(*) AS m FROM {points} JOIN %s GROUP BY {keys}, b))) GROUP BY {keys})"""
    ctes = [f"{name}_0 AS " + best % "(SELECT 0.01 + i * (1.99 / 399) AS b FROM range(400) r(i)) ON true"]
    width = 1.99 / 399
    for k in range(1, rounds + 1):
        near = f"(SELECT DISTINCT {keys}, least(greatest(b + i * {width / 10!r}::DOUBLE, 0.01), 2.0) AS b FROM {name}_{k - 1}, range(-10, 11) r(i)) USING ({keys})"
        ctes.append(f"{name}_{k} AS " + best % near)
        width /= 10
    return ", ".join([*ctes, f"{name} AS (SELECT * FROM {name}_{rounds})"])


#: The fits of the mean curves and of all draws.
FITS = f"""{BOOT}, means AS (SELECT split, method_id, train_size - 1994 AS n, avg(mae) AS y FROM runs GROUP BY 1, 2, 3), drawn AS (SELECT split, method_id, draw, train_size - 1994 AS n, y FROM boot),
 {_fits_sql("means", "split, method_id", "fit")}, {_fits_sql("drawn", "split, method_id, draw", "draws")}"""


def _crossings_sql(fits: str, keys: str) -> str:
    """(keys, m1, m2, x): the last of 4,000 points from 1 to 7 before the curves of a named pair change places."""
    named = ", ".join(f"('{one}', '{two}')" for one, two in CROSSING)
    sign = "sign((p.a * pow({x}, -p.b) + p.c) - (q.a * pow({x}, -q.b) + q.c))"
    at = {k: sign.format(x=k) for k in ("x", "nx")}
    return f"""(SELECT {keys}, m1, m2, min(x) FILTER (WHERE s <> t) AS x FROM (SELECT {keys}, m1, m2, x, {at["x"]} AS s, {at["nx"]} AS t FROM (VALUES {named}) v(m1, m2) JOIN {fits} p ON p.method_id = m1 JOIN (SELECT {keys}, method_id AS m2, a, b, c FROM {fits}) q USING ({keys}, m2),
  (SELECT pow(7.0, i / 3999.0) AS x, pow(7.0, (i + 1) / 3999.0) AS nx FROM range(3999) r(i))) GROUP BY {keys}, m1, m2)"""


@query(f"""WITH {FITS}, point AS {_crossings_sql("fit", "split")}, found AS {_crossings_sql("draws", "split, draw")},
 sp AS (SELECT a.split, a.train_size, a.method_id AS m1, b.method_id AS m2, a.mae - b.mae AS d FROM runs a JOIN runs b ON a.split = b.split AND a.train_size = b.train_size AND a.seed = b.seed AND a.method_id < b.method_id),
 seen AS (SELECT split, m1, m2, string_agg(train_size || ':' || printf('%.5f', mean), ',' ORDER BY train_size) AS mean_diff_by_size, string_agg(train_size || ':' || better, ',' ORDER BY train_size) AS seeds_better_by_size
  FROM (SELECT split, m1, m2, train_size, avg(d) AS mean, count(*) FILTER (WHERE d < 0) AS better FROM sp GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
 spread AS (SELECT split, m1, m2, count(x) / count(*) AS found, CASE WHEN count(x) > 20 THEN quantile_cont(x, 0.025) END AS lo, CASE WHEN count(x) > 20 THEN quantile_cont(x, 0.975) END AS hi FROM found GROUP BY 1, 2, 3)
 SELECT split, m1, m2, round(x, 4) AS crossover, round(found, 6) AS found, round(lo, 4) AS lo, round(hi, 4) AS hi, mean_diff_by_size, seeds_better_by_size FROM point JOIN spread USING (split, m1, m2) LEFT JOIN seen USING (split, m1, m2)""")
def crossover_bootstrap(spark, d):
    """For each pair: where its curves cross, in how many draws they do, the middle 95 % (null for 20 draws or fewer), mean differences and better seeds by size."""
    errors = checkpointed(runs(spark, d))
    draws = curves.fitted(_boot_curves(errors), "split", "method_id", "draw")
    point = curves.crossover(curves.paired_fits(curves.fitted(_points(errors), "split", "method_id", parts=4), CROSSING, "split"), "split", "m1", "m2", low=1, high=7)
    diffs = ranking.seed_pairs(errors).groupBy("split", "train_size", "m1", "m2").agg(F.avg("d").alias("mean"), F.count_if(F.col("d") < 0).alias("better"))
    by_size = {"mean_diff_by_size": F.format_string("%d:%.5f", "train_size", "mean"), "seeds_better_by_size": F.format_string("%d:%d", "train_size", "better")}
    seen = diffs.groupBy("split", "m1", "m2").agg(*[F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("train_size", text.alias("t")))), lambda x: x["t"]), ",").alias(k) for k, text in by_size.items()])
    keys = ["split", "m1", "m2"]
    out = point.join(curves.bootstrap_crossovers(draws, CROSSING, low=1, high=7), keys).join(seen, keys, "left")
    return out.select(*keys, *[F.round(k, 6 if k == "found" else 4).alias(k) for k in ("crossover", "found", "lo", "hi")], *by_size)


@query(f"""WITH {FITS}, top AS (SELECT split, method_id, max(c) AS top FROM draws GROUP BY 1, 2),
 spread AS (SELECT split, method_id, quantile_cont(b, 0.025) AS b_lo, quantile_cont(b, 0.975) AS b_hi, quantile_cont(c, 0.025) AS c_lo, quantile_cont(c, 0.975) AS c_hi, avg(CASE WHEN abs(c - top) <= 1e-8 + 1e-5 * abs(top) THEN 1.0 ELSE 0.0 END) AS most FROM draws JOIN top USING (split, method_id) GROUP BY 1, 2)
 SELECT split, method_id, round(a, 5) AS a, round(b, 5) AS b, round(c, 5) AS c, round(b_lo, 5) AS b_lo, round(b_hi, 5) AS b_hi, round(c_lo, 5) AS c_lo, round(c_hi, 5) AS c_hi, round(most, 5) AS c_at_upper_bound, round(a * pow(7, -b) + c, 5) AS fit, round(y, 5) AS observed
 FROM fit LEFT JOIN spread USING (split, method_id) LEFT JOIN (SELECT split, method_id, y FROM means WHERE n = 7) USING (split, method_id)""")
def curve_fit_report(spark, d):
    """Each curve's fit, the middle 95 % of b and c over the draws, the share of draws at the largest c, and fit against observation at the last size."""
    errors = checkpointed(runs(spark, d))
    points = _points(errors)
    point = curves.fitted(points, "split", "method_id", parts=4)
    draws = curves.fitted(_boot_curves(errors), "split", "method_id", "draw")
    report = curves.fit_report(point, draws, points, 7)
    return report.select("split", "method_id", *[F.round(k, 5).alias(k) for k in report.columns[2:]])


GRID = """grid AS (SELECT 0.01 + i * (1.99 / 399) AS b FROM range(400) r(i)),
 f AS (SELECT split, method_id, draw, b, regr_intercept(y, pow(n, -b)) AS c0, min(y) AS low, sum(pow(n, -b) * y) AS zy, sum(pow(n, -b)) AS sz, sum(pow(n, -b) * pow(n, -b)) AS zz, sum(y * y) AS yy, sum(y) AS sy, count(*) AS m FROM pts, grid GROUP BY 1, 2, 3, 4),
 g AS (SELECT *, least(greatest(c0, 0.0), low) AS c FROM f), h AS (SELECT *, greatest((zy - c * sz) / zz, 0.0) AS a FROM g),
 k AS (SELECT *, yy + a*a*zz + m*c*c - 2*a*zy - 2*c*sy + 2*a*c*sz AS ssr FROM h),
 fits AS (SELECT split, method_id, draw, arg_min(c, (round(ssr, 12), b)) AS c FROM k GROUP BY 1, 2, 3)"""


@query(f"WITH {BOOT}, pts AS (SELECT split, method_id, draw, train_size - 1994 AS n, y FROM boot), {GRID}, mx AS (SELECT split, method_id, max(c) AS top FROM fits GROUP BY 1, 2) SELECT split, method_id, round(avg(CASE WHEN abs(c - top) <= 1e-8 + 1e-5 * abs(top) THEN 1.0 ELSE 0.0 END), 6) AS share FROM fits JOIN mx USING (split, method_id) GROUP BY 1, 2")
def isclose_fraction(spark, d):
    """The share of draws whose fitted c is the largest of its curve."""
    keys = ["split", "method_id"]
    fits = checkpointed(curves.fit_grid(checkpointed(_boot_curves(runs(spark, d))).repartition(64, *keys, "draw"), *keys, "draw"))
    most = fits.groupBy(*keys).agg(F.max("c").alias("top"))
    close = F.abs(F.col("c") - F.col("top")) <= 1e-8 + 1e-5 * F.abs("top")
    return fits.join(F.broadcast(most), keys).groupBy(*keys).agg(F.round(F.avg(close.cast("double")), 6).alias("share"))


@query("""WITH e AS (SELECT label % 10 AS rec, generate_subscripts(embedding, 1) AS dim, unnest(embedding) AS v FROM embeddings), s AS (SELECT dim, rec, avg(abs(v)) AS g FROM e GROUP BY 1, 2),
 m AS (SELECT dim, avg(g) AS mean_gain, stddev_samp(g) AS std_gain, count(*) AS n_records FROM s GROUP BY 1)
 SELECT CAST(dim AS INTEGER) AS dim, round(mean_gain, 5) AS mean_gain, round(std_gain, 5) AS std_gain, n_records, CAST(row_number() OVER (ORDER BY mean_gain DESC, dim) AS INTEGER) AS rnk FROM m ORDER BY mean_gain DESC, dim LIMIT 20""")
def importance_topk(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label") % 10).alias("rec"), F.posexplode("embedding").alias("dim", "v"))
    s = e.groupBy((F.col("dim") + 1).alias("dim"), "rec").agg(F.avg(F.abs(F.col("v").cast("double"))).alias("g"))
    m = s.groupBy("dim").agg(F.avg("g").alias("mean_gain"), F.stddev_samp("g").alias("std_gain"), F.count(F.lit(1)).alias("n_records"))
    top = m.orderBy(F.desc("mean_gain"), "dim").limit(20)
    return top.withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("mean_gain"), "dim"))).select("dim", F.round("mean_gain", 5).alias("mean_gain"), F.round("std_gain", 5).alias("std_gain"), "n_records", "rnk")


@query("""WITH e AS (SELECT label % 10 AS rec, generate_subscripts(embedding, 1) AS dim, unnest(embedding) AS v FROM embeddings WHERE label IS NOT NULL),
 s AS (SELECT CASE WHEN rec % 2 = 0 THEN 'random' ELSE 'scaffold' END AS split, dim, rec, avg(abs(v)) AS g FROM e GROUP BY 1, 2, 3),
 m AS (SELECT split, dim, avg(g) AS mean_gain, stddev_samp(g) AS std_gain, count(*) AS n_records FROM s GROUP BY 1, 2 UNION ALL SELECT 'combined', dim, avg(g), stddev_samp(g), count(*) FROM s GROUP BY 2),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY split ORDER BY round(mean_gain, 9) DESC, dim) AS INTEGER) AS rnk FROM m)
 SELECT split, CAST(dim AS INTEGER) AS dim, CASE WHEN dim <= 8 THEN 'first dimensions' WHEN dim % 2 = 0 THEN 'even dimensions' ELSE 'other dimension' END AS category, round(mean_gain, 5) AS mean_gain, round(std_gain, 5) AS std_gain, n_records,
  CASE WHEN split <> 'combined' THEN rnk END AS rank_within_split, CASE WHEN split = 'combined' THEN rnk END AS combined_rank FROM r""")
def importance_ranks(spark, d):
    """Importance by split and over both in one aggregation, with a category, the rank within a split and the combined rank."""
    e = table(spark, d, "embeddings").where("label IS NOT NULL").select((F.col("label") % 10).alias("rec"), F.posexplode("embedding").alias("pos", "v"))
    split = F.when(F.col("rec") % 2 == 0, "random").otherwise("scaffold")
    s = e.groupBy(split.alias("split"), (F.col("pos") + 1).alias("dim"), "rec").agg(F.avg(F.abs(F.col("v").cast("double"))).alias("g"))
    m = s.groupingSets([[F.col("split"), F.col("dim")], [F.col("dim")]], "split", "dim").agg(F.avg("g").alias("mean_gain"), F.stddev_samp("g").alias("std_gain"), F.count(F.lit(1)).alias("n_records"))
    # a partition holds one row for each dimension of the vectors
    r = m.withColumn("split", F.coalesce("split", F.lit("combined"))).withColumn("rnk", F.row_number().over(Window.partitionBy("split").orderBy(F.desc(F.round("mean_gain", 9)), "dim")))
    category = F.when(F.col("dim") <= 8, "first dimensions").when(F.col("dim") % 2 == 0, "even dimensions").otherwise("other dimension")
    ranks = [F.when(F.col("split") != "combined", F.col("rnk")).alias("rank_within_split"), F.when(F.col("split") == "combined", F.col("rnk")).alias("combined_rank")]
    return r.select("split", "dim", category.alias("category"), F.round("mean_gain", 5).alias("mean_gain"), F.round("std_gain", 5).alias("std_gain"), "n_records", *ranks)


@query(f"""SELECT split, dim, category, mean_gain, std_gain, CASE WHEN split <> 'combined' THEN n_records END AS n_seeds, n_records, rank_within_split, combined_rank, mean_gain AS importance_for_plot, std_gain AS std_for_plot,
 coalesce(rank_within_split, combined_rank) AS rank_for_plot FROM ({ORACLE["importance_ranks"]}) WHERE coalesce(rank_within_split, combined_rank) <= 20""")
def importance_figure(spark, d):
    """The first 20 dimensions of each split and of both, with the columns of the published figure's table; a record of a split is a seed."""
    r = importance_ranks(spark, d).withColumn("rank_for_plot", F.coalesce("rank_within_split", "combined_rank")).where("rank_for_plot <= 20")
    more = {"n_seeds": F.when(F.col("split") != "combined", F.col("n_records")), "importance_for_plot": F.col("mean_gain"), "std_for_plot": F.col("std_gain")}
    return r.withColumns(more)


@query(f"""WITH {PAIRS}, loo AS ({LOO.format(t="pairs").replace("round(", "").replace(", 4)", "")}), l AS (SELECT pairs.*, loo.loo FROM pairs JOIN loo USING (k)), line AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM pairs),
 r AS (SELECT round(avg(abs(y - x)), 6) AS mae, round(sqrt(avg((y - x) ** 2)), 6) AS rmse, round(avg(y - x), 6) AS ms, count(y - x) AS n, round(avg(abs(loo - y)), 6) AS lmae, round(sqrt(avg((loo - y) ** 2)), 6) AS lrmse, round(avg(loo - y), 6) AS lms, count(loo - y) AS ln FROM l)
 SELECT CAST(json_object('raw', json_object('n', n, 'mae', mae, 'rmse', rmse, 'mean_signed', ms), 'line', json_object('slope', round(slope, 6), 'intercept', round(intercept, 6), 'spread', NULL), 'loo', json_object('n', ln, 'mae', lmae, 'rmse', lrmse, 'mean_signed', lms), 'constants', json_object('shift', 0.044::DOUBLE)) AS VARCHAR) AS report FROM r, line""")
def nested_report(spark, d):
    p = pairs(spark, d)

    loo = stats.leave_one_out(p, "y", "x").agg(F.struct(*stats.error_metrics(F.col("y"), F.col("loo"))).alias("loo"))
    base = p.agg(F.struct(*stats.error_metrics(F.col("x"), F.col("y"))).alias("raw"), F.struct(*stats.line_fit("y", "x")).alias("line"))
    spread = optional_column(p, "Range")

    def rounded(name: str, *fields: str):
        return F.struct(*[F.col(f"{name}.n")][: name != "line"], *[F.round(f"{name}.{f}", 6).alias(f) for f in fields]).alias(name)

    errors = ("mae", "rmse", "mean_signed")
    parts = [rounded("raw", *errors), rounded("line", "slope", "intercept").withField("spread", spread).alias("line"), rounded("loo", *errors), F.struct(F.lit(0.044).alias("shift")).alias("constants")]
    return base.crossJoin(loo).select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("report"))


# --- beyond the reference ---


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def setop_intersect_except(spark, d):
    o = table(spark, d, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey")
    return of("O").intersect(of("F")).subtract(of("P"))
