"""Golden values and laws of the dataflow engine on small tables."""

import graphlib

import pytest
from pyspark.sql import functions as F

from tickframe.functions import expressions, scalar, typing
from tickframe.operators import analysis, delta, flow, rewrite
from tickframe.plans import clock, composite, dag, sweep, templates
from tickframe.sources import artifacts, bundle, history
from tickframe.streaming import stateful


def test_growth(spark):
    df = spark.createDataFrame([("a", 1.0)], "id string, level double")
    grow = composite.Process("grow", 1.0, lambda s, h: {"level": F.col("level") * 0.5 * h})
    assert composite.Composite(df, processes=[grow]).run(3.0).visible().first().level == 3.375
    assert df.select(clock.fold(F.col("level"), 3, lambda x, _: x + x * 0.5).alias("x")).first().x == 3.375
    assert df.select(clock.fold(F.col("level"), 0, lambda x, _: x + 1).alias("x")).first().x == 1.0
    assert [r.value for r in clock.trajectory(df, F.col("level"), 0, lambda x, _: x).collect()] == [1.0]


def test_steps(spark):
    two = dag.Graph().add(dag.operator_step("2", "*", "b", "c", "d"), dag.operator_step("1", "+", "a", "b", "c"))
    assert two.run(spark.createDataFrame([(13.0, 21.0)], "a double, b double")).first().d == 714.0
    g = dag.Graph().add(
        dag.operator_step("1", "+", "a", "b", "e"), dag.operator_step("2.1", "-", "c", "e", "f"), dag.operator_step("2.2", "-", "d", "e", "g"), dag.operator_step("3", "*", "f", "g", "h"), dag.operator_step("4", "+", "e", "h", "i")
    )
    assert g.layers() == [["1"], ["2.1", "2.2"], ["3"], ["4"]]
    row = g.run(spark.createDataFrame([(11.111, 22.2, 555.555)], "a double, b double, c double")).first()
    assert row.h == -17396.469884
    assert g.triggered({"c"}) == [["2.1"], ["3"], ["4"]]
    assert g.downstream({"2.2"}) == {"2.2", "3", "4"}
    assert set(dag.without(g, {"3"}).steps) == {"1", "2.1", "2.2"}
    loop = dag.Graph().add(dag.Step("x", {"i": "p"}, {"o": "q"}, lambda i: {"o": i["i"]}, priority=1), dag.Step("y", {"i": "q"}, {"o": "p"}, lambda i: {"o": i["i"]}))
    assert loop.layers() == [["x"], ["y"]]
    assert dag.overlaps("a/*/c", "a/b") and not dag.overlaps("a/x", "a/b")
    assert dag.topological_order({"c": {"a", "b"}, "b": set(), "a": set()}) == ["a", "b", "c"]
    with pytest.raises(graphlib.CycleError):
        dag.topological_order({"a": {"b"}, "b": {"a"}})


def test_registry(spark):
    r = dag.Registry()

    @r.step(["x"], ["y"])
    def scale(ports, *, factor=2.0):
        return {"y": ports["x"] * factor}

    @r.generator(factor=("float", 3.0))
    def doubled(factor):
        return dag.Graph().add(r.steps["scale"]("s", {"x": "a"}, {"y": "b"}, factor=factor))

    df = spark.createDataFrame([(2.0,)], "a double")
    assert r.build("doubled").run(df).first().b == 6.0 and r.build("doubled", factor="5").run(df).first().b == 10.0
    with pytest.raises(ValueError):
        r.build("doubled", other=1)
    with pytest.raises(ValueError):
        r.steps["scale"]("s", {}, {"y": "b"})
    assert r.snapshot() == {"steps": ["scale"], "generators": ["doubled"]}


def test_types():
    assert typing.parse_type("map[name:float]").apply == "keys"
    assert typing.parse_type("float{1.5}").default == 1.5
    assert typing.parse_type({"_type": "float", "_units": "fg"}).units == "fg"
    assert typing.parse_type("list[tuple[path,list[float]]]").data.simpleString() == "array<struct<_1:array<string>,_2:array<double>>>"
    assert typing.parse_type("array[(3), float]").apply == "add"
    expected = [("float", "float", "exact"), ("integer", "float", "widened"), ("overwrite[float]", "float", "semantics_shifted"), ({"_type": "float", "_units": "g"}, "float", "semantics_shifted"), ("string", "map[float]", "irreconcilable"), ("maybe[float]", "float", "widened")]
    for a, b, want in expected:
        assert typing.crossing(a, b).value == want
    assert typing.coerce_value("3", "int") == 3 and typing.coerce_value("yes", "bool") is True and typing.coerce_value(2, "float") == 2.0
    for value, kind in ((3.7, "integer"), (True, "float"), ("maybe", "boolean"), (None, "string"), ({}, "list"), ("x", "float")):
        with pytest.raises(ValueError):
            typing.coerce_value(value, kind)


def test_addresses(spark):
    # Addresses that must stay as they are.
    golden = [(("study", {}, [], ""), "78ae3a35a0fe5f89"), (("study", {"seed": 0}, [], "abc123"), "5c4c0be0af218633"), (("study", {"seed": 0}, ["bbb", "aaa"], "abc123"), "365bd943a78cd82f"), (("study", {"b": 2, "a": 1}, [], ""), "a70c18c5c80eb729"), (("study", {"seed": 1.0}, [], ""), "7cfd48d2cf54e4b6"), (("study", {"n": [1.0, 2, 3.5]}, [], ""), "66e1fbdc641f035a")]
    for args, want in golden:
        assert scalar.artifact_address(*args) == want
        name, config, inputs, commit = args
        column = scalar.address_column(F.lit(name), F.lit(scalar.canonical_json(config)), F.array(*map(F.lit, inputs)).cast("array<string>"), F.lit(commit))
        assert spark.range(1).select(column.alias("x")).first().x == want
    assert scalar.canonical_json({"b": True, "a": 1.0}) == '{"a":1,"b":true}'


def test_scalars(spark):
    assert scalar.unit_factor("fg", "pg") * 1000 == 1.0
    with pytest.raises(ValueError):
        scalar.unit_factor("g", "s")
    assert scalar.axis_label("m (kg)", "kg") == "m (kg)"
    assert scalar.substitute({"a": "${n}", "b": "x${n}", "c": [1]}, {"n": 5}) == {"a": 5, "b": "x5", "c": [1]}
    assert scalar.parameter_key({"a": 1, "b": {"c": 2}}) == "{a:1,b:{c:2}}"
    assert scalar.interval_values({"low": 1, "high": 2}) == [1, 2] and scalar.interval_values({"1": 5, "0": 4}) == [4, 5] and scalar.interval_values(3) == [3]
    assert scalar.path_prefixes("a/b") == ["", "a", "a/b"]
    row = spark.range(1).select(scalar.path_column(F.lit("a.b/c-d")).alias("p"), scalar.add_at(F.array(F.lit(1.0), F.lit(2.0)), F.create_map(F.lit("1"), F.lit(0.5))).alias("v"), scalar.narrowed(F.lit(2.0)).alias("n")).first()
    assert (row.p, row.v, row.n) == ("a_b_c_d", [1.0, 2.5], "2")
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert expressions.evaluate(df, {"z": "y ** 2", "y": "where(a > b, a, -b)"}).first().z == 4.0
    with pytest.raises(ValueError):
        expressions.evaluate(df, {"z": "nothing + 1"})
    with pytest.raises(graphlib.CycleError):
        expressions.evaluate(df, {"z": "y", "y": "z"})


def test_maps_and_rows(spark):
    m = spark.range(1).select(delta.apply_map(F.create_map(F.lit("a"), F.lit(1.0)), F.create_map(F.lit("a"), F.lit(5.0), F.lit("new"), F.lit(9.0))).alias("m"))
    assert m.first().m == {"a": 6.0}
    pool = spark.createDataFrame([("0", 3.0), ("1", 1.0), (None, None)], "agent string, mass double")
    assert sorted(map(tuple, delta.divide_rows(pool, F.col("mass") > 2, "agent", ["mass"]).collect()), key=str) == [("0_0", 1.5), ("0_1", 1.5), ("1", 1.0), (None, None)]
    with pytest.raises(ValueError):
        delta.deep_merge(pool, spark.createDataFrame([("0", "x")], "agent string, mass string"), ["agent"])
    left = spark.createDataFrame([(None, 1, "l"), (2, 2, "l")], "k int, a int, x string")
    right = spark.createDataFrame([(None, "r"), (None, "r"), (3, "r")], "k int, x string")
    assert sorted(map(tuple, flow.join(left, right, ["k"]).collect())) == [(None, 1, "r")] * 2
    assert flow.join(left, right, ["k"], null_keys_match=False).count() == 0
    assert flow.mix(left, right).count() == 5


def test_histories(spark, tmp_path):
    df = spark.createDataFrame([("s", k, float(k)) for k in range(11)], "run string, step long, v double")
    assert [r.step for r in history.subsample(df, 5).orderBy("step").collect()] == [0, 5, 10]
    assert sorted(r.step for r in history.latest(df, 3, ["run"], ["step"]).collect()) == [8, 9, 10]
    emitter = history.Emitter("sim", every=5)
    state = spark.createDataFrame([("a", 0.0)], "id string, v double")
    composite.Composite(state, processes=[composite.Process("p", 1.0, lambda s, h: {"v": F.lit(1.0)})], emit=emitter).run(16.0)
    assert [(r.step, r.v) for r in emitter.history().orderBy("step").collect()] == [(0, 1.0), (5, 6.0), (10, 11.0), (15, 16.0)]
    kept = history.Emitter("sim", most=3)
    composite.Composite(state, processes=[composite.Process("p", 1.0, lambda s, h: {"v": F.lit(1.0)})], emit=kept).run(10.0)
    assert sorted(r.global_time for r in kept.history().collect()) == [8.0, 9.0, 10.0]
    stored = history.Emitter("one", folder=str(tmp_path / "h"), paths=["id", "v"])
    composite.Composite(state, processes=[composite.Process("p", 2.0, lambda s, h: {"v": F.lit(h)})], emit=stored).run(4.0)
    assert [(r.global_time, r.v) for r in stored.history().orderBy("step").collect()] == [(2.0, 2.0), (4.0, 4.0)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.json").write_text('{"step": 1, "v": 2.5}\n{"step": 2, "v"')
    assert [tuple(r) for r in history.read_json(spark, str(tmp_path / "j"), "step long, v double").collect()] == [(1, 2.5)]
    nested = df.select(F.struct(F.struct("v").alias("b"), "step").alias("a"))
    assert history.leaves(nested.schema) == ["a.b.v", "a.step"]
    assert history.query_paths(nested, ["a.b.v"], flat=False).first().a.b.v == 0.0
    document = {"x": {"$table": "t"}, "n": [1]}
    assert bundle.save_bundle(spark, document, {"t": df}, str(tmp_path / "b")) == {"t": 11}
    assert bundle.load_bundle(spark, str(tmp_path / "b"))["x"].count() == 11


def test_clock(spark):
    for bad in (0, 0.0, -1.0, float("nan"), True, None):
        with pytest.raises(ValueError, match="node"):
            clock.check_interval(bad, "node")
    p = spark.createDataFrame([("a", 1.0), ("b", 2.5)], "process string, interval double")
    fires = clock.schedule(p, 5.0)
    assert sorted((r.process, r.apply_time) for r in fires.collect()) == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("a", 5.0), ("b", 2.5), ("b", 5.0)]
    assert clock.next_event(fires, 2.0).first().next_time == 2.5
    seen = []
    state = spark.createDataFrame([(1.0,)], "x double")
    clock.loop(state, 10, lambda s, t: s, halt=lambda s, t: seen.append(t) or t == 3)
    assert seen == [1, 2, 3]
    levels = spark.createDataFrame([(i, 1.0, 0.1 + 0.01 * i) for i in range(12)], "id int, level double, rate double")
    run = lambda df: sorted((r.id, r.level) for r in df.select("id", clock.fold(F.col("level"), 10, lambda x, _: x + x * F.col("rate")).alias("level")).collect())
    assert run(levels.coalesce(1)) == run(levels.repartition(7))


def test_templates(spark):
    doc = {"a": {"_type": "site", "_default": 1}, "b": {"c": {"_type": "site"}}}
    assert set(templates.open_sites(doc)) == {("a",), ("b", "c")} and set(templates.required_sites(doc)) == {("b", "c")}
    assert templates.fill(doc, {"c": 5}) == {"a": 1, "b": {"c": 5}}
    with pytest.raises(ValueError, match="b/c"):
        templates.fill(doc, {})
    members = {"p": {}, "a": {"upstream": ["p"]}, "b": {"upstream": ["a"], "hole": {"_type": "site"}}, "c": {"upstream": ["b"]}}
    assert templates.prune(members)[1] == {"b", "c"}
    assert templates.ancestors(members, "c") == ["p", "a", "b"]
    with pytest.raises(graphlib.CycleError):
        templates.ancestors({"x": {"upstream": ["y"]}, "y": {"upstream": ["x"]}}, "x")
    out, done = templates.trigger(members, "a", lambda n: spark.range(3), lambda n, up: up["p"])
    assert out.count() == 3 and done == {"p": "pulled", "a": "computed", "b": "pruned", "c": "pruned"}
    with pytest.raises(LookupError):
        templates.trigger(members, "a", lambda n: None, lambda n, up: spark.range(1), on_missing="fail")


def test_artifacts(spark, tmp_path):
    store = artifacts.Store(spark, str(tmp_path))
    calls = []
    compute = lambda: calls.append(1) or spark.range(5)
    a = store.pull_or_compute("n", {"x": 1}, [], compute)
    b = store.pull_or_compute("n", {"x": 1.0}, [], compute)
    assert (a[1], a[2], b[2], len(calls)) == (b[1], False, True, 1)
    store.write("f", spark.range(9), fingerprint=True)
    assert store.is_reproducible("f", spark.range(9).repartition(4)) and not store.is_reproducible("f", spark.range(8)) and store.fingerprint("none") is None


def test_rewriting(spark):
    nodes = spark.createDataFrame([("r", "bldg", None, "building"), ("r", "alice", "bldg", "person"), ("r", "bob", "bldg", "person"), ("r", "lab", "bldg", "room")], "run string, node string, parent string, control string")
    rule = rewrite.MoveRule("enter", "person", "building", "room", 100.0)
    out = {r.node: r.parent for r in rewrite.fire(nodes, rewrite.first_match(rewrite.matches(nodes, [rule]))).collect()}
    assert out == {"bldg": None, "alice": "lab", "bob": "bldg", "lab": "bldg"}
    events = rewrite.gillespie(nodes, [rule], 10.0, seed=1).collect()
    times = [e.time for e in sorted(events, key=lambda e: e.event)]
    assert {e.node for e in events} == {"alice", "bob"} and times == sorted(times) and max(times) <= 10
    again = rewrite.gillespie(nodes.repartition(3), [rule], 10.0, seed=1).collect()
    assert sorted(events) == sorted(again)


def test_sweep_and_analysis(spark):
    runs = sweep.grid(spark, kdeg=[0.0, 0.1, 1.0, 10.0])
    assert runs.count() == 4 and runs.first().run_id == "kdeg=0.0"
    done = sweep.scatter(spark.createDataFrame([(1, 1.0), (2, 2.0)], "m int, start double"), "m", {"level": F.col("start") + 3.0 * 2})
    assert sweep.gather(done, [], "level").first().level == {"1": 7.0, "2": 8.0}
    pool = spark.createDataFrame([("p", 1, 5.0), ("p", 2, 5.0), ("p", 3, 1.0), ("q", 4, 2.0)], "run string, m int, v double")
    got = {r.m: (r.others_sum, r.others_n, r.best_peer) for r in analysis.neighbourhood(pool, "run", "m", "v").collect()}
    assert got == {1: (6.0, 2, 2), 2: (6.0, 2, 1), 3: (10.0, 2, 1), 4: (0.0, 0, None)}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, float(k), f"2024-01-01 00:{k:02d}:00") for k in range(30)], "key long, v double, t string").withColumn("t", F.col("t").cast("timestamp"))
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    out = stateful.to_table(stateful.running_totals(source, "key", "v"), "totals", "update", str(tmp_path / "c1"))
    last = {r.key: r.t for r in out.groupBy("key").agg(F.max("total").alias("t")).collect()}
    assert last == {0: 135.0, 1: 145.0, 2: 155.0}
    win = stateful.windowed(source, "t", "10 minutes", "1 hour", ["key"], [F.sum("v").alias("total")])
    table = stateful.to_table(win, "windows", "complete", str(tmp_path / "c2"))
    assert table.count() == 9 and table.agg(F.sum("total").alias("s")).first().s == 435.0


def test_varying_intervals_say_when_they_stop_short(spark):
    run = lambda most: clock.varying_intervals(spark.range(1), 1.0, F.lit(1.0), F.lit(0.1), lambda x, _: x + 1, lambda _: F.lit(0.1), most).collect()
    assert run(20)[0].fires == 10
    with pytest.raises(Exception, match="not at the end after 5 fires"):
        run(5)


def _diamonds(spark, n):
    return spark.createDataFrame([e for k in range(n) for e in ((f"{k}", f"{k}a"), (f"{k}", f"{k}b"), (f"{k}a", f"{k + 1}"), (f"{k}b", f"{k + 1}"))], "upstream string, node string")


def test_closure_counts_a_node_once_whatever_the_ways_to_it(spark):
    edges = _diamonds(spark, 22).unionByName(spark.createDataFrame([("22", "0")], "upstream string, node string"))
    got = {r.node: r.depth for r in clock.recursive_closure(edges, spark.createDataFrame([("0",)], "node string")).collect()}
    assert len(got) == 67 and got["22"] == 44 and got["0"] == 0 and got["7b"] == 15


def test_layers_take_the_longest_way_and_name_a_cycle(spark):
    edges = _diamonds(spark, 6).unionByName(spark.createDataFrame([("0", "6"), ("x", "1a")], "upstream string, node string"))
    got = {r.node: r.layer for r in clock.depth_layers(edges, spark.createDataFrame([("alone",)], "node string")).collect()}
    assert (got["6"], got["x"], got["1a"], got["alone"], len(got)) == (12, 0, 3, 0, 21)
    with pytest.raises(ValueError, match="a cycle holds p, q"):
        clock.depth_layers(spark.createDataFrame([("p", "q"), ("q", "p"), ("z", "p")], "upstream string, node string"), spark.createDataFrame([], "node string"))


def test_simulation_takes_every_match_at_its_rate(spark):
    rows = [(str(run), *n) for run in range(400) for n in (("b", None, "building"), ("m", "b", "agent"), ("n", "b", "agent"), ("x", "b", "room"), ("y", "b", "room"))]
    nodes = spark.createDataFrame(rows, "run string, node string, parent string, control string")
    rules = [rewrite.MoveRule("enter", "agent", "building", "room", 1.0), rewrite.MoveRule("pair", "agent", "building", "agent", 2.0)]
    first = [e for e in rewrite.gillespie(nodes, rules, 50.0, seed=3).collect() if e.event == 0]
    count = {}
    for e in first:
        count[e.node, e.target] = count.get((e.node, e.target), 0) + 1
    # Four ways at rate 1 and two at rate 2: eight in all.
    assert set(count) == {(a, t) for a in "mn" for t in "xy"} | {("m", "n"), ("n", "m")}
    assert all(abs(c / 400 - (0.25 if t in "mn" else 0.125)) < 0.08 for (_, t), c in count.items())
    mean = sum(e.time for e in first) / len(first)
    assert abs(mean - 1 / 8) < 0.03
    with pytest.raises(Exception, match="not at the end after 1 events"):
        rewrite.gillespie(nodes, rules, 50.0, most=1, seed=3).collect()
