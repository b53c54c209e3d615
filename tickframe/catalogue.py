"""The registered queries over the star-schema tables, each with the DuckDB SQL of the same result.

Money columns are summed as decimals, so sums are exact and don't depend on row order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe.functions import expressions, motion, scalar, typing
from tickframe.operators import analysis, delta, flow, pool, rewrite
from tickframe.plans import clock, composite, dag, sweep, templates, workflow
from tickframe.sources import artifacts, bundle, history
from tickframe.streaming import stateful

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column) -> Column:
    return F.sum(F.col(column).cast("decimal(18,2)") if isinstance(column, str) else column.cast("decimal(18,2)")).cast("double")


def micros(column: str = "ts") -> Column:
    """Microseconds of a timestamp without zone."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def shared(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder (a local one only where none is set)."""
    return f"{clock.shared_root(spark)}/{name}-{uuid.uuid4().hex}"


# --- flow -----------------------------------------------------------------------------


@query("""SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def flow_mix(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return flow.mix(c, s)


@query("SELECT count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation")
def flow_collect(spark, d):
    rows = flow.collect(read(spark, d, "nation"), "n_nationkey")
    return rows.select(F.size("collected").cast("long").alias("n"), F.array_join(F.transform("collected", lambda r: r["n_name"]), ",").alias("names"))


@query("SELECT r_regionkey, r_name, n_nationkey, n_name FROM region CROSS JOIN nation")
def flow_combine(spark, d):
    return flow.combine(read(spark, d, "region"), read(spark, d, "nation")).select("a.r_regionkey", "a.r_name", "b.n_nationkey", "b.n_name")


@query("""SELECT o_custkey, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids
FROM orders GROUP BY o_custkey""")
def flow_group(spark, d):
    groups = flow.group(read(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey")
    keys = F.transform("items", lambda r: r["o_orderkey"])
    return groups.select("o_custkey", F.size("items").cast("long").alias("n"), F.array_min(keys).alias("lo"), F.array_max(keys).alias("hi"), F.array_join(keys.cast("array<string>"), ",").alias("ids"))


@query("""SELECT l.l_orderkey AS key, l.l_linenumber AS line, l.l_quantity AS quantity, o.o_orderstatus AS status, o.o_totalprice AS price
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_linestatus = o.o_orderstatus""")
def flow_join_multi(spark, d):
    left = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    right = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return flow.join(left, right, ["key", "status"])


@query("""WITH l AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS k, o_orderkey AS a FROM orders),
r AS (SELECT CASE WHEN c_custkey = 1 THEN NULL ELSE c_custkey END AS k, c_name AS b FROM customer)
SELECT l.k, a, b FROM l JOIN r ON l.k IS NOT DISTINCT FROM r.k""")
def flow_join_nullsafe(spark, d):
    """Orders without a customer meet the one customer without a key."""
    left = read(spark, d, "orders").select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("k"), F.col("o_orderkey").alias("a"))
    right = read(spark, d, "customer").select(F.when(F.col("c_custkey") != 1, F.col("c_custkey")).alias("k"), F.col("c_name").alias("b"))
    return flow.join(left, right, ["k"])


# --- deltas and structure -------------------------------------------------------------


@query("""SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) + coalesce(d, 0) AS DOUBLE) AS balance FROM customer LEFT JOIN
(SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS d FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def delta_reconcile_apply(spark, d):
    store = read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(28,2)").alias("balance"))
    deltas = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").cast("decimal(18,2)").alias("balance"))
    rules = {"balance": "add"}
    return delta.apply_delta(store, delta.reconcile(deltas, ["c_custkey"], rules), ["c_custkey"], rules).withColumn("balance", F.col("balance").cast("double"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + p_size ELSE p_retailprice END AS known, CAST(2 AS BIGINT) AS keys FROM part""")
def delta_map_existing_only(spark, d):
    value = F.create_map(F.lit("price"), F.col("p_retailprice"), F.lit("size"), F.col("p_size").cast("double"))
    change = F.create_map(F.lit("unknown"), F.lit(9.0), F.when(F.col("p_partkey") % 2 == 0, "price").otherwise("other"), F.col("p_size").cast("double"))
    out = delta.apply_map(value, change)
    return read(spark, d, "part").select("p_partkey", F.element_at(out, "price").alias("known"), F.size(out).cast("long").alias("keys"))


@query("""SELECT c_custkey, coalesce(s, 'none') AS status FROM customer LEFT JOIN
(SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def delta_overwrite(spark, d):
    store = read(spark, d, "customer").select("c_custkey", F.lit("none").alias("status"))
    deltas = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey")
    one = delta.reconcile(deltas, ["c_custkey"], {"status": "set"}, ["o_orderdate", "o_orderkey"])
    return delta.apply_delta(store, one, ["c_custkey"], {"status": "set"})


@query("""SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY o_custkey""")
def delta_extend(spark, d):
    deltas = read(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.array(F.col("o_orderkey").cast("string")).alias("orders"))
    one = delta.reconcile(deltas, ["o_custkey"], {"orders": "extend"}, ["o_orderdate", "o_orderkey"])
    return one.select("o_custkey", F.array_join("orders", ",").alias("orders"))


@query("""SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey % 10 <> 3 UNION ALL
SELECT s_suppkey, 0.0 FROM supplier WHERE s_suppkey % 10 = 3 UNION ALL SELECT s_suppkey + 1000000, 1.0 FROM supplier WHERE s_suppkey % 10 = 4""")
def struct_add(spark, d):
    s = read(spark, d, "supplier")
    store = s.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    new = s.filter("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("k"), F.lit(0.0).alias("v"))
    more = s.filter("s_suppkey % 10 = 4").select((F.col("s_suppkey") + 1000000).alias("k"), F.lit(1.0).alias("v"))
    return delta.add_rows(store, new.unionByName(more), ["k"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def struct_remove(spark, d):
    gone = read(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return delta.remove_rows(read(spark, d, "customer").select("c_custkey", "c_acctbal"), gone, ["c_custkey"])


@query("""SELECT s_name AS agent, s_acctbal AS mass, s_nationkey AS place FROM supplier WHERE NOT s_acctbal > 5000
UNION ALL SELECT s_name || '_' || i, s_acctbal / 2, s_nationkey FROM supplier, (VALUES ('0'), ('1')) t(i) WHERE s_acctbal > 5000""")
def struct_divide(spark, d):
    pool = read(spark, d, "supplier").select(F.col("s_name").alias("agent"), F.col("s_acctbal").alias("mass"), F.col("s_nationkey").alias("place"))
    return delta.divide_rows(pool, F.col("mass") > 5000, "agent", ["mass"])


@query("""WITH a AS (SELECT p_partkey AS k, p_retailprice AS price, p_size AS size FROM part WHERE p_partkey % 3 <> 0),
b AS (SELECT p_partkey AS k, p_retailprice * 2 AS price, p_brand AS brand FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(a.k, b.k) AS k, coalesce(b.price, a.price) AS price, size, brand FROM a FULL OUTER JOIN b ON a.k = b.k""")
def deep_merge(spark, d):
    p = read(spark, d, "part")
    base = p.filter("p_partkey % 3 != 0").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    over = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") * 2).alias("price"), F.col("p_brand").alias("brand"))
    return delta.deep_merge(base, over, ["k"])


@query("""SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_change FROM events""")
def tick_changes(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), "value")
    return delta.tick_changes(e, ["user_id"], "at", ["value"]).select("event_id", "value_change")


@query("""WITH p AS (SELECT DISTINCT CASE WHEN n_nationkey % 3 = 0 THEN 'r' || n_regionkey ELSE 'r' || n_regionkey || '/n' || n_nationkey END AS path FROM nation)
SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE starts_with(p.path, q.path || '/'))""")
def distinct_prefixes(spark, d):
    r, n = F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("/n"), F.col("n_nationkey").cast("string"))
    paths = read(spark, d, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, r).otherwise(F.concat(r, n)).alias("path"))
    return delta.distinct_prefixes(paths)


# --- steps and expressions ------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, (l_quantity + l_tax) AS c, l_tax * (l_quantity + l_tax) AS d FROM lineitem")
def step_chain(spark, d):
    g = dag.Graph().add(dag.operator_step("later", "*", "b", "c", "d"), dag.operator_step("first", "+", "a", "b", "c"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"))
    return g.run(rows).select("l_orderkey", "l_linenumber", "c", "d")


@query("""SELECT l_orderkey, l_linenumber, e, f, g, f * g AS h, e + f * g AS i FROM (SELECT *, l_quantity + l_extendedprice AS e,
l_discount - (l_quantity + l_extendedprice) AS f, 0.0 - (l_quantity + l_extendedprice) AS g FROM lineitem)""")
def step_diamond(spark, d):
    g = dag.Graph().add(
        dag.operator_step("1", "+", "a", "b", "e"), dag.operator_step("2.1", "-", "c", "e", "f"), dag.operator_step("2.2", "-", "d", "e", "g"), dag.operator_step("3", "*", "f", "g", "h"), dag.operator_step("4", "+", "e", "h", "i")
    )
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_discount").alias("c"))
    return g.run(rows).select("l_orderkey", "l_linenumber", *"efghi")


@query("""SELECT l_orderkey, l_linenumber, round(CAST(l_quantity AS DOUBLE) + l_tax + l_discount, 9) AS total, CAST(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS DOUBLE) AS level FROM lineitem""")
def layer_reconcile(spark, d):
    """Steps of one layer write to the same columns: what they add is summed, of what they set the last one holds."""
    add = lambda name, port: dag.Step(name, {"x": port}, {"out": "total"}, lambda i: {"out": i["x"]}, apply="add")
    g = dag.Graph().add(
        add("tax", "tax"),
        add("discount", "discount"),
        dag.Step("one", {"x": "tax"}, {"out": "level"}, lambda i: {"out": F.lit(1.0)}),
        dag.Step("two", {"f": "flag"}, {"out": "level"}, lambda i: {"out": F.lit(2.0)}, when=lambda i: i["f"] == "R"),
    )
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("total"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"), F.lit(0.0).alias("level"))
    return g.run(rows).select("l_orderkey", "l_linenumber", F.round("total", 9).alias("total"), "level")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS price, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END + 1 AS next FROM orders""")
def step_guard_trigger(spark, d):
    """A guarded step changes some rows; a change of its column sets off the step that reads it, and no other."""
    g = dag.Graph().add(
        dag.Step("double", {"p": "price", "s": "status"}, {"out": "price2"}, lambda i: {"out": i["p"] * 2}, when=lambda i: i["s"] == "F"),
        dag.Step("next", {"p": "price2"}, {"out": "next"}, lambda i: {"out": i["p"] + 1}),
        dag.Step("never", {"x": "other"}, {"out": "next"}, lambda i: {"out": i["x"]}),
    )
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_totalprice").alias("price2"))
    return g.run(rows, {"price"}).select("o_orderkey", F.col("price2").alias("price"), "next")


@query("""SELECT event_id, value * 2 + 1 AS a, floor(tanh((value * 2 + 1) / 100) * 1000000 + 0.5) / 1000000 AS b, floor(ln(value * 2 + 2) * 1000000 + 0.5) / 1000000 AS c,
CASE WHEN value > 10 THEN value - 10 ELSE 0.0 END AS d FROM events WHERE value >= 0""")
def expr_pipeline(spark, d):
    rows = expressions.evaluate(read(spark, d, "events").filter("value >= 0"), {"c": "log(a + 1)", "b": "tanh(a / 100)", "d": "where(value > 10, value - 10, 0.0)", "a": "value * 2 + 1"})
    return rows.select("event_id", "a", scalar.rounded(F.col("b"), 6).alias("b"), scalar.rounded(F.col("c"), 6).alias("c"), "d")


@query("""SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity * p_retailprice / 7) AS BIGINT) AS n FROM lineitem JOIN part ON p_partkey = l_partkey""")
def star_counts(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * F.col("p_retailprice") / 7).cast("bigint").alias("n"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) * CAST(0.001 AS DOUBLE) AS size_kg, 'size (kg)' AS label FROM part")
def unit_scale(spark, d):
    size = F.col("p_size").cast("double")
    return read(spark, d, "part").select("p_partkey", scalar.scaled(size, "g", "kg").alias("size_kg"), F.lit(scalar.axis_label("size", "kg")).alias("label"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END AS as_integer, CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 3 = 1 THEN false END AS as_boolean FROM part""")
def coerce_columns(spark, d):
    number = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("x")))
    word = F.when(F.col("p_size") % 3 == 0, " Yes ").when(F.col("p_size") % 3 == 1, "OFF").otherwise("maybe")
    return read(spark, d, "part").select("p_partkey", typing.coerce_column(number, "integer").cast("int").alias("as_integer"), typing.coerce_column(word, "boolean").alias("as_boolean"))


# --- time -----------------------------------------------------------------------------

_GROW = """WITH RECURSIVE t(c_custkey, step, value) AS (SELECT c_custkey, 0, c_acctbal FROM customer UNION ALL SELECT c_custkey, step + 1, value + value * 0.05 FROM t WHERE step < 10)"""


@query(_GROW + " SELECT c_custkey, value FROM t WHERE step = 10")
def grow_fold(spark, d):
    return read(spark, d, "customer").select("c_custkey", clock.fold(F.col("c_acctbal"), 10, lambda x, _: x + x * 0.05).alias("value"))


@query(_GROW + " SELECT c_custkey, step, value FROM t WHERE step % 5 = 0")
def grow_trajectory(spark, d):
    rows = clock.trajectory(read(spark, d, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal"), 10, lambda x, _: x + x * 0.05)
    return history.subsample(rows, 5).select("c_custkey", "step", "value")


@query("""WITH RECURSIVE t(r_regionkey, kdeg, step, value) AS (SELECT r_regionkey, kdeg, 0, CAST(13.3333 AS DOUBLE) + r_regionkey FROM region, (VALUES (0.0::DOUBLE), (0.1), (1.0), (10.0)) k(kdeg)
UNION ALL SELECT r_regionkey, kdeg, step + 1, value + value * (CAST(0.5 AS DOUBLE) - kdeg) * CAST(0.1 AS DOUBLE) FROM t WHERE step < 20) SELECT r_regionkey, kdeg, step, value FROM t""")
def toy_sweep(spark, d):
    runs = sweep.over(read(spark, d, "region").select("r_regionkey"), sweep.grid(spark, kdeg=[0.0, 0.1, 1.0, 10.0]))
    start = F.lit(13.3333).cast("double") + F.col("r_regionkey")
    return clock.trajectory(runs, start, 20, lambda x, _: x + x * (F.lit(0.5) - F.col("kdeg")) * 0.1).select("r_regionkey", "kdeg", "step", "value")


@query("""SELECT 'a=' || a || ',b=' || b AS run_id, a, b, a * b AS area FROM (VALUES (1.0::DOUBLE), (2.0)) x(a), (VALUES (0.5::DOUBLE), (1.5), (2.5)) y(b)""")
def parameter_grid(spark, d):
    return sweep.grid(spark, a=[1, 2], b=[0.5, 1.5, 2.5]).withColumn("area", F.col("a") * F.col("b"))


@query("""WITH RECURSIVE t(s_suppkey, step, x) AS (SELECT s_suppkey, 0, s_acctbal / 1000 FROM supplier UNION ALL
SELECT s_suppkey, step + 1, x + (2.0 / (1 + (x / 3.0) * (x / 3.0)) - 0.4 * x) * 0.1 FROM t WHERE step < 15) SELECT s_suppkey, floor(x * 1000000 + 0.5) / 1000000 AS x FROM t WHERE step = 15""")
def hill_feedback(spark, d):
    def step(x, _):
        return x + (F.lit(2.0) / (1 + (x / 3.0) * (x / 3.0)) - x * 0.4) * 0.1

    return read(spark, d, "supplier").select("s_suppkey", scalar.rounded(clock.fold(F.col("s_acctbal") / 1000, 15, step), 6).alias("x"))


@query("""WITH p(process, h) AS (VALUES ('a', 1.0::DOUBLE), ('b', 2.5), ('c', 4.0)) SELECT process, CAST(k AS INTEGER) AS fire, k * h AS read_time, (k + 1) * h AS apply_time
FROM p, LATERAL (SELECT unnest(generate_series(0, CAST(floor(10 / h) AS BIGINT) - 1)) AS k)""")
def multi_rate_schedule(spark, d):
    p = spark.createDataFrame([("a", 1.0), ("b", 2.5), ("c", 4.0)], "process string, interval double")
    return clock.schedule(p, 10.0)


@query("SELECT 4.0::DOUBLE AS next_time")
def next_event(spark, d):
    p = spark.createDataFrame([("b", 2.5), ("c", 4.0)], "process string, interval double")
    return clock.next_event(clock.schedule(p, 10.0), 3.0)


@query("""SELECT event_id, coalesce(CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 3600000000 PRECEDING) AS DOUBLE), 0) AS state FROM events""")
def delayed_apply(spark, d):
    """The state that each event reads: deltas computed from earlier events land an hour after they were read."""
    e = read(spark, d, "events").select("event_id", "user_id", micros().alias("at"), F.col("value").cast("decimal(18,2)").alias("v"))
    order = Window.partitionBy("user_id").orderBy("at").rangeBetween(Window.unboundedPreceding, -3_600_000_000)
    return e.select("event_id", F.coalesce(F.sum("v").over(order).cast("double"), F.lit(0.0)).alias("state"))


@query("""SELECT r.event_id, (SELECT arg_max(w.value, (w.ts, w.event_id)) FROM events w WHERE w.event_type = 'purchase' AND w.user_id = r.user_id AND w.ts <= r.ts) AS held
FROM events r WHERE r.event_type = 'click'""")
def zero_order_hold(spark, d):
    e = read(spark, d, "events")
    w = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("held"))
    return clock.hold(e.filter("event_type = 'click'").select("user_id", "ts", "event_id"), w, ["user_id"], "ts", "held").select("event_id", "held")


@query("""SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS state FROM events""")
def running_state(spark, d):
    e = read(spark, d, "events").withColumn("v", F.col("value").cast("decimal(18,2)"))
    return clock.running_state(e, ["user_id"], ["ts", "event_id"], "v").select("event_id", F.col("state").cast("double").alias("state"))


@query("""WITH RECURSIVE t(k, time, x, h, fires) AS (SELECT s_suppkey, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 0::BIGINT FROM supplier UNION ALL
SELECT k, time + h, x + h * (1 + k % 3), CASE WHEN x + h * (1 + k % 3) > 4 THEN 0.25 ELSE 1.0 END, fires + 1 FROM t WHERE time + h <= 8)
SELECT k AS s_suppkey, arg_max(time, fires) AS time, arg_max(x, fires) AS state, max(fires) AS fires FROM t GROUP BY k""")
def adaptive_intervals(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey")
    rate = 1 + F.col("s_suppkey") % 3
    out = clock.varying_intervals(s, 8.0, F.lit(1.0), F.lit(1.0), lambda x, h: x + h * rate, lambda x: F.when(x > 4, 0.25).otherwise(1.0), 64)
    return out.select("s_suppkey", "time", "state", "fires")


@query("""WITH RECURSIVE t(c_custkey, time, a, b) AS (SELECT c_custkey, 0, c_acctbal, 0.0::DOUBLE FROM customer UNION ALL
SELECT c_custkey, time + 1, a + a * 0.1, CASE WHEN time % 2 = 1 THEN b + 2.0 ELSE b END FROM t WHERE time < 6) SELECT c_custkey, a AS amount, a + b AS total FROM t WHERE time = 6""")
def composite_run(spark, d):
    """Two processes of intervals 1 and 2 and a step over one store, through the bridge."""
    state = read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), F.lit(0.0).alias("b"))
    steps = dag.Graph().add(dag.operator_step("sum", "+", "a", "b", "total"))
    grow = composite.Process("grow", 1.0, lambda s, h: {"a": F.col("a") * 0.1 * h})
    drip = composite.Process("drip", 2.0, lambda s, h: {"b": F.lit(1.0) * h})
    return composite.Composite(state, steps, [grow, drip], {"c_custkey": "c_custkey", "amount": "a", "total": "total"}).run(6.0).read_bridge()


# --- histories ------------------------------------------------------------------------

_STEPS = "WITH h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)"


def _history(spark, d):
    return history.numbered(read(spark, d, "events"), ["user_id"], ["ts", "event_id"])


@query(_STEPS + " SELECT user_id, step, value FROM h WHERE step % 5 = 0")
def emit_subsample(spark, d):
    return history.subsample(_history(spark, d), 5).select("user_id", F.col("step").cast("long").alias("step"), "value")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def emit_ring(spark, d):
    return history.latest(read(spark, d, "events"), 3, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("SELECT event_id, value AS state_inner_value, CAST(props->>'k' AS BIGINT) AS state_k FROM events")
def emit_query_paths(spark, d):
    e = read(spark, d, "events")
    nested = e.select("event_id", F.struct(F.struct("value").alias("inner"), F.get_json_object("props", "$.k").cast("long").alias("k")).alias("state"))
    return history.query_paths(nested, ["event_id", "state.inner.value", "state.k"])


@query("SELECT event_type, CAST(sum(CAST(props->>'k' AS BIGINT)) AS DOUBLE) / count(props->>'k') AS mean_k FROM events GROUP BY event_type")
def emit_history_mean(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, d, "events").groupBy("event_type").agg((F.sum(k).cast("double") / F.count(k)).alias("mean_k"))


@query("SELECT user_id, count(*) AS step_count FROM events GROUP BY user_id")
def list_runs(spark, d):
    return history.runs(read(spark, d, "events"), "user_id")


@query(_STEPS + " SELECT user_id AS simulation_id, step, value FROM h WHERE user_id IN (3, 5)")
def emit_parquet_store(spark, d):
    """A history written to a store partitioned by run, and two runs read back."""
    folder = shared(spark, "history")
    history.write_parquet(_history(spark, d).select(F.col("user_id").alias("simulation_id"), F.col("step").cast("long").alias("step"), "value"), folder)
    return history.read_parquet(spark, folder, runs_wanted=[3, 5]).select(F.col("simulation_id").cast("long").alias("simulation_id"), "step", "value")


@query("SELECT event_id AS step, user_id AS simulation_id, value FROM events")
def emit_json_store(spark, d):
    folder = shared(spark, "json")
    history.write_json(read(spark, d, "events").select(F.col("event_id").alias("step"), F.col("user_id").alias("simulation_id"), "value"), folder)
    return history.read_json(spark, folder, "step long, simulation_id long, value double")


@query("""SELECT user_id, event_id AS step, 'value' AS observable, value FROM events UNION ALL SELECT user_id, event_id, 'k', CAST(props->>'k' AS DOUBLE) FROM events""")
def observables_long(spark, d):
    state = F.to_json(F.struct(F.col("value"), F.get_json_object("props", "$.k").cast("double").alias("k")))
    rows = read(spark, d, "events").select(F.col("user_id").alias("simulation_id"), F.col("event_id").alias("step"), F.lit(0.0).alias("global_time"), state.alias("state"))
    return history.observables(rows).select(F.col("simulation_id").alias("user_id"), "step", "observable", "value")


@query("""SELECT user_id, count(*) AS n, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id""")
def timeseries_wide(spark, d):
    e = read(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    out = analysis.time_series(e, ["user_id"], "at", ["value"])
    return out.select("user_id", F.size("value").cast("long").alias("n"), F.element_at("value", 1).alias("first_value"), F.element_at("value", -1).alias("last_value"))


@query("""SELECT o_custkey, string_agg(o_orderkey || '=' || CAST(floor(o_totalprice) AS BIGINT), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS results FROM orders GROUP BY o_custkey""")
def scatter_gather(spark, d):
    o = read(spark, d, "orders")
    found = o.select("o_custkey", F.col("o_orderkey").cast("string").alias("match_key"), F.floor("o_totalprice").cast("bigint").cast("string").alias("result"))
    maps = sweep.gather(found, ["o_custkey"], "result")
    return maps.select("o_custkey", F.array_join(F.transform(F.array_sort(F.map_entries("result")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("results"))


# --- analysis -------------------------------------------------------------------------


@query("""WITH c AS (SELECT c_nationkey, c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS v FROM customer)
SELECT c_nationkey, c_custkey, CAST(sum(v) OVER w - v AS DOUBLE) AS others_sum, count(*) OVER w - 1 AS others_n,
(SELECT arg_max(o.c_custkey, (o.v, -o.c_custkey)) FROM c o WHERE o.c_nationkey = c.c_nationkey AND o.c_custkey <> c.c_custkey) AS best_peer FROM c WINDOW w AS (PARTITION BY c_nationkey)""")
def pool_neighbour(spark, d):
    c = read(spark, d, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("v"))
    return analysis.neighbourhood(c, "c_nationkey", "c_custkey", "v").withColumn("others_sum", F.col("others_sum").cast("double"))


@query("""SELECT event_type, CAST(s AS DOUBLE) AS seconds, floor(CAST(s AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE) * 1000000 + 0.5) / 1000000 AS share FROM
(SELECT event_type, sum(CAST(value AS DECIMAL(18,2))) AS s FROM events GROUP BY event_type) ORDER BY s DESC, event_type LIMIT 3""")
def timing_top(spark, d):
    out = analysis.timing_summary(read(spark, d, "events"), "event_type", F.col("value").cast("decimal(18,2)"))
    total = F.sum("seconds").over(Window.partitionBy()).cast("double")
    out = out.select("event_type", F.col("seconds").cast("double").alias("seconds"), scalar.rounded(F.col("seconds").cast("double") / total, 6).alias("share"))
    return out.orderBy(F.desc("seconds"), "event_type").limit(3)


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 2500 THEN 'pass' ELSE 'fail' END AS verdict FROM customer")
def threshold_verdict(spark, d):
    return read(spark, d, "customer").select("c_custkey", analysis.verdict(F.col("c_acctbal"), 2500).alias("verdict"))


@query("""SELECT CAST(floor((l_extendedprice - 0) / 5000) AS BIGINT) AS bin, floor(l_extendedprice / 5000) * 5000 AS lower, count(*) AS n FROM lineitem WHERE l_extendedprice >= 0 AND l_extendedprice < 100000 GROUP BY ALL""")
def hist_bins(spark, d):
    return analysis.histogram(read(spark, d, "lineitem"), "l_extendedprice", 0.0, 100000.0, 20)


@query("""SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) AS F, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_linestatus = 'O') AS DOUBLE) AS O FROM lineitem GROUP BY l_returnflag""")
def heatmap_pivot(spark, d):
    return analysis.heatmap(read(spark, d, "lineitem"), "l_linestatus", "l_returnflag", money("l_quantity"), ["F", "O"])


@query("""SELECT user_id, CAST(arg_max(props->>'k', (ts, event_id)) AS BIGINT) AS x, arg_max(value, (ts, event_id)) AS y FROM events GROUP BY user_id""")
def param_vs_observable(spark, d):
    e = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return analysis.final_by_parameter(e, "user_id", "k", ["ts", "event_id"], "value")


@query("""SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, max(value) FILTER (WHERE event_type = 'click') AS x, max(value) FILTER (WHERE event_type = 'view') AS y FROM events
GROUP BY ALL HAVING x IS NOT NULL AND y IS NOT NULL""")
def phase_space(spark, d):
    e = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    return analysis.phase_space(e, ["user_id"], "day", "event_type", "value", "click", "view")


@query("""SELECT vec_id, len(embedding) AS size, floor(list_sum(list_transform(embedding[1:5], lambda x: CAST(x AS DOUBLE))) * 1000000 + 0.5) / 1000000 AS head_sum FROM embeddings""")
def value_summary(spark, d):
    s = analysis.value_summary(F.col("embedding"))
    rows = read(spark, d, "embeddings").select("vec_id", s.alias("s"))
    return rows.select("vec_id", F.col("s.size").cast("long").alias("size"), scalar.rounded(F.aggregate("s.head", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("head_sum"))


# --- vectors, strings, hashes ---------------------------------------------------------


@query("""SELECT a.vec_id, floor(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) * 100000 + 0.5) / 100000 AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_dot(spark, d):
    e = read(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(b, "vec_id").select("vec_id", scalar.rounded(scalar.dot(F.col("embedding"), F.col("next")), 5).alias("dot"))


@query("""SELECT a.vec_id, i - 1 AS j, CAST(a.embedding[i] AS DOUBLE) + CAST(b.embedding[i] AS DOUBLE) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, LATERAL (SELECT unnest(generate_series(1, 4)) AS i)""")
def vector_add(spark, d):
    wide = F.transform("embedding", lambda x: x.cast("double"))
    e = read(spark, d, "embeddings").select("vec_id", wide.alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    both = e.join(b, "vec_id").select("vec_id", F.slice(scalar.add_arrays(F.col("v"), F.col("w")), 1, 4).alias("s"))
    return bundle.matrix_rows(both, "s", "vec_id").select("vec_id", F.col("j").cast("long").alias("j"), "value")


@query("""SELECT p_partkey, 'part-' || p_name || '/' || p_size AS text FROM part""")
def placeholder_subst(spark, d):
    return read(spark, d, "part").select("p_partkey", scalar.substitute_column(F.lit("part-${name}/${size}"), name=F.col("p_name"), size=F.col("p_size")).alias("text"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'brand=' || p_brand || ', size=' || p_size WHEN p_partkey % 3 = 1 THEN p_name ELSE right('run-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0'), 6) END AS label FROM part""")
def run_label(spark, d):
    params = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")))
    name = F.when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise("")
    run_id = F.concat(F.lit("run-"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    return read(spark, d, "part").select("p_partkey", scalar.run_label(params, name, run_id).alias("label"))


_CONFIG = """'{"brand":"' || p_brand || '","size":' || p_size || '}'"""


@query(f"""SELECT p_partkey, left(sha256(concat_ws(chr(10), 'part', {_CONFIG}, CASE WHEN p_type < p_name THEN p_type || chr(10) || p_name ELSE p_name || chr(10) || p_type END, 'c0ffee')), 16) AS address FROM part""")
def artifact_address(spark, d):
    config = scalar.canonical_struct(size=F.col("p_size"), brand=F.col("p_brand"))
    return read(spark, d, "part").select("p_partkey", scalar.address_column(F.lit("part"), config, F.array("p_name", "p_type"), F.lit("c0ffee")).alias("address"))


@query("""SELECT p_partkey, 'pulled' AS how FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'computed' FROM part WHERE p_partkey % 4 <> 0""")
def pull_or_compute(spark, d):
    wanted = read(spark, d, "part").select("p_partkey", F.sha2(F.col("p_partkey").cast("string"), 256).alias("address"))
    stored, missing = artifacts.split_by_catalogue(wanted, wanted.filter("p_partkey % 4 = 0"))
    return stored.select("p_partkey", F.lit("pulled").alias("how")).unionByName(missing.select("p_partkey", F.lit("computed").alias("how")))


@query("""SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS safe, left(sha1(url), 8) AS element FROM pages""")
def html_ids(spark, d):
    return read(spark, d, "pages").select("page_id", scalar.html_escape(F.col("url")).alias("safe"), scalar.element_id(F.col("url")).alias("element"))


@query("""SELECT n_nationkey, 'org' || n_regionkey AS owner, 'repo' || n_nationkey AS repo, 'main' AS ref, 'pkg.mod' AS module, 'make' AS function FROM nation""")
def git_addresses(spark, d):
    text = F.format_string("org%d/repo%d@main#pkg.mod:make", "n_regionkey", "n_nationkey")
    return read(spark, d, "nation").select("n_nationkey", scalar.git_address(text).alias("a")).select("n_nationkey", "a.*")


@query("""SELECT c_mktsegment, count(*) AS rows, 16 AS digits FROM customer GROUP BY c_mktsegment""")
def bundle_round_trip(spark, d):
    """Tables saved beside a document and read back by reference."""
    folder = shared(spark, "bundle")
    bundle.save_bundle(spark, {"name": "demo", "stores": {"customers": {"$table": "customers"}}}, {"customers": read(spark, d, "customer")}, folder)
    held = bundle.load_bundle(spark, folder)["stores"]["customers"]
    return held.groupBy("c_mktsegment").agg(F.count("*").alias("rows")).withColumn("digits", F.length(F.lit(artifacts.content_fingerprint(held))))


@query("""SELECT 'first' AS run, false AS pulled, count(*) AS n FROM nation UNION ALL SELECT 'second', true, count(*) FROM nation""")
def artifact_store(spark, d):
    store = artifacts.Store(spark, shared(spark, "store"))
    compute = lambda: read(spark, d, "nation")
    out = None
    for run in ("first", "second"):
        df, _, pulled = store.pull_or_compute("nations", {"v": 1.0}, [], compute)
        row = df.agg(F.count("*").alias("n")).select(F.lit(run).alias("run"), F.lit(pulled).alias("pulled"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# --- structure ------------------------------------------------------------------------


@query("""WITH w AS (SELECT p_brand, p_partkey, p_size, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS c, sum(p_size) OVER (PARTITION BY p_brand) AS t FROM part)
SELECT p_brand, min(p_partkey) AS p_partkey FROM w WHERE c >= 0.37 * t GROUP BY p_brand""")
def weighted_pick(spark, d):
    return rewrite.weighted_pick(read(spark, d, "part"), ["p_brand"], ["p_partkey"], "p_size", F.lit(0.37)).select("p_brand", "p_partkey")


def _places(spark, d):
    """Regions hold nations; in each region nations with an odd key are rooms, the others are agents."""
    n = read(spark, d, "nation")
    kind = F.when(F.col("n_nationkey") % 2 == 1, "room").otherwise("agent")
    nations = n.select(F.col("n_regionkey").cast("string").alias("run"), F.format_string("n%02d", "n_nationkey").alias("node"), F.lit("root").alias("parent"), kind.alias("control"))
    regions = read(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("run"), F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("building").alias("control"))
    return nations.unionByName(regions)


_RULE = rewrite.MoveRule("enter", "agent", "building", "room")


@query("""WITH n AS (SELECT CAST(n_regionkey AS VARCHAR) AS run, format('n{:02d}', n_nationkey) AS node, n_nationkey % 2 AS odd FROM nation),
m AS (SELECT run, min(node) FILTER (WHERE odd = 0) AS mover, min(node) FILTER (WHERE odd = 1) AS room FROM n GROUP BY run)
SELECT n.run, node, CASE WHEN node = mover AND room IS NOT NULL THEN room ELSE 'root' END AS parent FROM n JOIN m ON n.run = m.run""")
def first_match_rewrite(spark, d):
    nodes = _places(spark, d)
    out = rewrite.fire(nodes, rewrite.first_match(rewrite.matches(nodes, [_RULE])))
    return out.filter("node != 'root'").select("run", "node", "parent")


@query()
def ssa_gillespie(spark, d):
    return rewrite.gillespie(_places(spark, d), [rewrite.MoveRule("enter", "agent", "building", "room", 0.5)], 10.0, seed=7)


_EDGES = "e AS (SELECT 'r' || n_regionkey AS upstream, 'n' || n_nationkey AS node FROM nation UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 10) FROM nation WHERE n_nationkey < 15)"


def _edges(spark, d):
    n = read(spark, d, "nation")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    a = n.select(name("r", F.col("n_regionkey")).alias("upstream"), name("n", F.col("n_nationkey")).alias("node"))
    return a.unionByName(n.filter("n_nationkey < 15").select(name("n", F.col("n_nationkey")).alias("upstream"), name("n", F.col("n_nationkey") + 10).alias("node")))


@query(f"""WITH RECURSIVE {_EDGES}, t(root, node, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION ALL SELECT root, e.node, depth + 1 FROM t JOIN e ON e.upstream = t.node)
SELECT root, node, min(depth) AS depth FROM t GROUP BY root, node""")
def downstream_closure(spark, d):
    seeds = read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return clock.recursive_closure(_edges(spark, d), seeds)


@query(f"""WITH RECURSIVE {_EDGES}, t(node, layer) AS (SELECT 'r' || r_regionkey, 0 FROM region UNION ALL SELECT e.node, layer + 1 FROM t JOIN e ON e.upstream = t.node) SELECT node, max(layer) AS layer FROM t GROUP BY node""")
def topo_layers(spark, d):
    edges = _edges(spark, d)
    nodes = edges.select("node").union(edges.select("upstream")).distinct()
    return clock.depth_layers(edges, nodes)


@query("""WITH RECURSIVE t(tick, agent, mass) AS (SELECT 0, s_name, s_acctbal / 1000 + 3 FROM supplier UNION ALL
SELECT tick + 1, CASE WHEN mass * 1.2 > 10 THEN agent || '_' || i ELSE agent END, CASE WHEN mass * 1.2 > 10 THEN mass * 1.2 / 2 ELSE mass * 1.2 END FROM t, (VALUES (0), (1)) d(i) WHERE tick < 5 AND (i = 0 OR mass * 1.2 > 10))
SELECT agent, mass FROM t WHERE tick = 5""")
def agent_pool_loop(spark, d):
    """Agents grow by a fifth a tick and divide above a mass of 10."""
    pool = read(spark, d, "supplier").select(F.col("s_name").alias("agent"), (F.col("s_acctbal") / 1000 + 3).alias("mass"))

    def tick(state, _):
        return delta.divide_rows(state.withColumn("mass", F.col("mass") * 1.2), F.col("mass") > 10, "agent", ["mass"])

    return clock.loop(pool, 5, tick)


@query("""WITH RECURSIVE t(tick, n, k, v) AS (SELECT 0, s_nationkey, s_suppkey, CAST(s_acctbal AS DECIMAL(28,2)) FROM supplier UNION ALL
SELECT tick + 1, n, k, CAST(CASE WHEN v > 0 AND sum(v) OVER (PARTITION BY n) - v > 5000 THEN v - 500 ELSE v + 100 END AS DECIMAL(28,2)) FROM t WHERE tick < 6) SELECT n AS nation, k AS supplier, CAST(v AS DOUBLE) AS value FROM t WHERE tick = 6""")
def shared_pool_loop(spark, d):
    """Each tick every member reads the sum of the others in its pool."""
    pool = read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supplier"), F.col("s_acctbal").cast("decimal(28,2)").alias("value"))

    def tick(state, _):
        total = state.groupBy("nation").agg(F.sum("value").alias("total"))
        joined = state.join(total, "nation")
        others = F.col("total") - F.col("value")
        new = F.when((F.col("value") > 0) & (others > 5000), F.col("value") - 500).otherwise(F.col("value") + 100)
        return joined.select("nation", "supplier", new.cast("decimal(28,2)").alias("value"))

    return clock.loop(pool, 6, tick).withColumn("value", F.col("value").cast("double"))


@query("""SELECT * FROM (VALUES ('float', 'float', 'exact'), ('integer', 'float', 'widened'), ('overwrite[float]', 'float', 'semantics_shifted'), ('string', 'float', 'irreconcilable'), ('map[integer]', 'map[float]', 'widened')) t(producer, consumer, crossing)""")
def port_crossings(spark, d):
    pairs = [("float", "float"), ("integer", "float"), ("overwrite[float]", "float"), ("string", "float"), ("map[integer]", "map[float]")]
    return spark.createDataFrame([(p, c, typing.crossing(p, c).value) for p, c in pairs], "producer string, consumer string, crossing string")


@query("""SELECT * FROM (VALUES ('parca', 'pulled'), ('a', 'computed'), ('b', 'pruned')) t(study, action)""")
def template_trigger(spark, d):
    members = {"parca": {}, "a": {"upstream": ["parca"]}, "b": {"upstream": ["a"]}}
    nation = read(spark, d, "nation")
    _, done = templates.trigger(members, "a", lambda n: nation if n == "parca" else None, lambda n, up: up["parca"].filter("n_regionkey = 1"))
    return spark.createDataFrame(list(done.items()), "study string, action string")


@query("""WITH RECURSIVE t(tick, run, agent, v, g, s) AS (SELECT 0, s_suppkey // 12, s_name, (s_suppkey % 7 - 3) * 0.75::DOUBLE, (s_suppkey % 5 - 1) * 0.5::DOUBLE, 0.8::DOUBLE FROM supplier
UNION ALL (WITH c AS (SELECT *, v < -3 AS low, v + g < -3 AS leaves, count(*) OVER w AS n, sum(CASE WHEN v < -3 THEN 1 ELSE 0 END) OVER w AS lows, sum(CASE WHEN v + g < -3 THEN 0 ELSE 1 END) OVER w AS stay FROM t WINDOW w AS (PARTITION BY run)),
k AS (SELECT *, NOT (lows - CAST(low AS INT) > 0) AND v + g > 3 AND n < 15 AND s <> 0 AS spawns FROM c WHERE NOT (leaves OR (low AND stay - CAST(NOT leaves AS INT) > 0)))
SELECT tick + 1, run, CASE WHEN i = 1 THEN agent || '_' || (tick + 1) ELSE agent END, CASE WHEN spawns THEN 0.5::DOUBLE ELSE v + g END, CASE WHEN i = 1 THEN s ELSE g END,
CASE WHEN i = 1 THEN CASE WHEN s * 0.625::DOUBLE > 0 AND s * 0.625::DOUBLE < 0.6 THEN -0.5::DOUBLE ELSE s * 0.625::DOUBLE END ELSE s END FROM k, (VALUES (0), (1)) d(i) WHERE tick < 8 AND (i = 0 OR spawns)))
SELECT CAST(run AS INTEGER) AS run, agent, v AS value, g AS growth FROM t WHERE tick = 8""")
def dynamic_pool(spark, d):
    """Members that grow, spawn and remove each other for eight ticks."""
    key = F.col("s_suppkey")
    start = read(spark, d, "supplier").select(
        F.floor(key / 12).cast("int").alias("run"), F.col("s_name").alias("agent"), ((key % 7 - 3) * 0.75).alias("value"), ((key % 5 - 1) * 0.5).alias("growth"), F.lit(0.8).alias("spawn_growth")
    )
    return clock.loop(start, 8, pool.pool_tick, every=3).select("run", "agent", "value", "growth")


@query("""WITH c AS (SELECT s_nationkey AS n, s_suppkey AS k, CAST(s_acctbal AS DECIMAL(18,2)) AS v FROM supplier),
a AS (SELECT *, CASE WHEN sum(v) OVER (PARTITION BY n) - v > 4000 THEN coalesce((SELECT arg_max(o.k, (o.v, -o.k)) FROM c o WHERE o.n = c.n AND o.k <> c.k), k) ELSE k END AS target FROM c),
s AS (SELECT n, target, count(*) * 100 AS d FROM a GROUP BY n, target)
SELECT a.n AS nation, a.k AS supplier, a.target, CAST(a.v + coalesce(s.d, 0) AS DOUBLE) AS value FROM a LEFT JOIN s ON s.n = a.n AND s.target = a.k""")
def pool_rewire(spark, d):
    """Members of rich pools write to their richest peer instead of themselves."""
    start = read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supplier"), F.col("s_acctbal").cast("decimal(18,2)").alias("value"))
    out = pool.deliver(pool.rewire(start, "nation", "supplier", "value", 4000), "nation", "supplier", "value", F.lit(100))
    return out.select("nation", "supplier", "target", F.col("value").cast("double").alias("value"))


@query()
def creation_annihilation(spark, d):
    return pool.create_and_annihilate(read(spark, d, "supplier").select("s_name", "s_acctbal"), "s_name", 0.2, 0.1, 5)


@query("""SELECT s_suppkey, CASE WHEN s_acctbal >= 4250 AND s_acctbal <= 5750 THEN 50000000 WHEN s_acctbal > 5750 THEN least(round(s_acctbal * 10000) - 7500000, 100000000) ELSE greatest(round(s_acctbal * 10000) + 7500000, 0) END / 10000 AS position FROM supplier""")
def move_toward(spark, d):
    s = read(spark, d, "supplier")
    return s.select("s_suppkey", scalar.rounded(motion.move_toward(F.col("s_acctbal"), F.lit(5000.0), 750.0, 0.0, 10000.0), 4).alias("position"))


@query("""SELECT s_suppkey, floor(s_acctbal / 1000 * exp(-0.5) * 10000 + 0.5) / 10000 AS x FROM supplier""")
def ode_decay(spark, d):
    """dx/dt = -x / 2 over one unit of time by Runge-Kutta steps; the SQL is the closed solution."""
    return read(spark, d, "supplier").select("s_suppkey", scalar.rounded(motion.integrate(F.col("s_acctbal") / 1000, lambda x, t: x * -0.5, 1.0, 64), 4).alias("x"))


@query("""SELECT e.user_id AS simulation_id, event_id AS step, 'value (mol)' AS label, value FROM events e WHERE user_id % 4 = 1""")
def load_runs(spark, d):
    """Runs chosen by name, their states read from JSON, labelled with units."""
    e = read(spark, d, "events")
    rows = e.select(F.col("user_id").alias("simulation_id"), F.col("event_id").alias("step"), F.lit(0.0).alias("global_time"), F.to_json(F.struct("value")).alias("state"))
    runs = e.select(F.col("user_id").alias("simulation_id"), F.concat(F.lit("study"), (F.col("user_id") % 4).cast("string")).alias("name")).distinct()
    units = history.observable_units(spark, {"value": {"units": "mol"}})
    found = history.load_runs(rows, runs, ["study1"]).join(F.broadcast(units), "observable")
    return found.select("simulation_id", "step", F.format_string("%s (%s)", "label", "units").alias("label"), "value")


@query("""SELECT s_suppkey, '{"s_acctbal":' || CAST(s_acctbal AS DECIMAL(18,2)) || ',"s_name":"' || s_name || '"}' AS state FROM supplier""")
def state_json(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("decimal(18,2)").alias("s_acctbal"))
    return history.state_json(s, ["s_suppkey"])


@query("""SELECT p_partkey, p_retailprice * 2 AS shown FROM part""")
def view_project(spark, d):
    """A step reads nested stores through wires and writes back; a subtree is stripped before it is shown."""
    rows = read(spark, d, "part").select("p_partkey", F.struct(F.struct(F.col("p_retailprice").alias("price")).alias("inner"), F.col("p_brand").alias("secret")).alias("store"))
    rows = history.stripped(rows, ["store.secret"])
    g = dag.Graph().add(dag.Step("double", {"x": "store_inner_price"}, {"y": "shown"}, lambda i: {"y": i["x"] * 2}))
    return g.run(history.query_paths(rows, ["p_partkey", "store.inner.price"])).select("p_partkey", "shown")


@query("""SELECT 'first' AS run, p_partkey, p_size * 3.0::DOUBLE AS level, false AS cache_hit FROM part WHERE p_size <= 25 UNION ALL SELECT 'second', p_partkey, p_size * 3.0::DOUBLE, p_size <= 25 FROM part""")
def sweep_store(spark, d):
    """A sweep of the small parts, then one of all over the same store: it computes only what is new."""
    store = artifacts.Store(spark, shared(spark, "sweep"))
    compute = lambda m: m.withColumn("level", F.col("p_size") * 3.0)
    part = read(spark, d, "part").select("p_partkey", "p_size")
    out = [workflow.sweep_with_store(part.filter(which), "levels", ["p_partkey", "p_size"], compute, store).select(F.lit(run).alias("run"), "p_partkey", "level", "cache_hit") for run, which in (("first", F.col("p_size") <= 25), ("second", F.lit(True)))]
    return out[0].unionByName(out[1])


@query("""SELECT * FROM (VALUES ('a', 'succeeded'), ('b', 'failed'), ('c', 'blocked'), ('d', 'succeeded')) t(node, status)""")
def workflow_status(spark, d):
    def fail(df):
        raise ValueError("no")

    nation = read(spark, d, "nation")
    results = workflow.run_workflow({"a": ([], lambda: nation), "b": (["a"], fail), "c": (["b"], lambda x: x), "d": (["a"], lambda x: x.limit(1))})
    return workflow.provenance(results, spark).select("node", "status")


@query("""WITH RECURSIVE t(k, time, x, y) AS (SELECT s_suppkey, 0, s_acctbal, s_acctbal * 0.0 FROM supplier UNION ALL SELECT k, time + 1, x + 2.0::DOUBLE, y + x * 0.5::DOUBLE FROM t WHERE time < 4) SELECT k AS s_suppkey, y AS outer_value FROM t WHERE time = 4""")
def nested_composite(spark, d):
    """An inner process whose state the outer one reads through a bridge, on one clock."""
    state = read(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("inner"), F.lit(0.0).alias("outer"))
    inner = composite.Process("inner", 1.0, lambda s, h: {"inner": F.lit(2.0) * h})
    outer = composite.Process("outer", 1.0, lambda s, h: {"outer": F.col("inner") * 0.5 * h})
    return composite.Composite(state, processes=[inner, outer], bridge={"s_suppkey": "s_suppkey", "outer_value": "outer"}).run(4.0).read_bridge()


# --- streaming ------------------------------------------------------------------------


@query("SELECT user_id AS key, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY user_id")
def stateful_stream(spark, d):
    """Totals per user from a stream of event files; the last update of each key is the batch result."""
    path, name = f"{d}/events.parquet", "totals_" + uuid.uuid4().hex
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).parquet(path if _is_folder(spark, path) else f"{d}/events*.parquet")
    out = stateful.to_table(stateful.running_totals(source, "user_id", "value"), name, "update", shared(spark, "stream"))
    last = out.groupBy("key").agg(F.max_by(F.struct("n", "total"), "n").alias("s"))
    return last.select("key", "s.n", "s.total")


def _is_folder(spark, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
