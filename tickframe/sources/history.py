"""Histories: what emitters record, how it is stored and how it is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def subsample(history: DataFrame, every: int, step: str = "step") -> DataFrame:
    """Every n-th recorded tick; the first is kept, and ticks keep their numbers."""
    return history.filter(F.col(step) % every == 0)


def latest(history: DataFrame, most: int, run: list[str], order: list[str]) -> DataFrame:
    """The most recent rows of each run. The filter on row_number becomes a per-task limit before the shuffle."""
    newest = Window.partitionBy(*run).orderBy(*[F.desc(c) for c in order])
    return history.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= most).drop("_n")


def numbered(history: DataFrame, run: list[str], order: list[str]) -> DataFrame:
    return history.withColumn("step", F.row_number().over(Window.partitionBy(*run).orderBy(*order)) - 1)


def query_paths(history: DataFrame, paths: list[str], flat: bool = True) -> DataFrame:
    """The named paths (a.b.c) of every row: flat columns a_b_c, or nested as they were."""
    if flat:
        return history.select(*[F.col(p).alias(p.replace(".", "_").replace("/", "_").replace("-", "_")) for p in paths])
    tree: dict = {}
    for p in paths:
        node = tree
        for part in p.split("."):
            node = node.setdefault(part, {})

    def build(node: dict, prefix: str) -> list[Column]:
        return [(F.struct(*build(v, f"{prefix}{k}.")) if v else F.col(f"{prefix}{k}")).alias(k) for k, v in node.items()]

    return history.select(*build(tree, ""))


def leaves(schema, prefix: str = "") -> list[str]:
    """Every leaf path of a schema: the ports of an emitter that records all."""
    out = []
    for f in schema:
        out += leaves(f.dataType, f"{prefix}{f.name}.") if hasattr(f.dataType, "fields") else [prefix + f.name]
    return out


def runs(history: DataFrame, run: str = "simulation_id") -> DataFrame:
    return history.groupBy(run).agg(F.count("*").alias("step_count"))


def write_json(history: DataFrame, folder: str, mode: str = "append") -> None:
    history.write.mode(mode).json(folder)


def read_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines or one JSON array per file; a broken line is left out."""
    lines = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)
    return lines


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_parquet(history: DataFrame, folder: str, run: str = "simulation_id", mode: str = "append") -> None:
    """Partitioned by run, so that reading a run reads its files only."""
    history.write.mode(mode).partitionBy(run).parquet(folder)


def read_parquet(spark: SparkSession, folder: str, run: str = "simulation_id", runs_wanted: list | None = None) -> DataFrame:
    df = spark.read.parquet(folder)
    return df if runs_wanted is None else df.filter(F.col(run).isin(*runs_wanted))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 8) -> DataFrame:
    """A history table behind JDBC, read in ranges of a numeric column if one is given. Needs a driver jar."""
    options = {"url": url, "dbtable": table} | ({"partitionColumn": column, "lowerBound": low, "upperBound": high, "numPartitions": parts} if column else {})
    return spark.read.format("jdbc").options(**options).load()


def observables(history: DataFrame, state: str = "state") -> DataFrame:
    """A history whose rows hold JSON states -> (simulation_id, step, global_time, observable, value)."""
    parsed = F.from_json(state, "map<string,double>")
    return history.select("simulation_id", "step", "global_time", F.explode(parsed).alias("observable", "value"))


class Emitter:
    """A sink for ticks: ``record`` takes a state and its time; ``history`` gives what was recorded.

    ``every`` and ``most`` thin and bound the history; with ``folder`` rows go to Parquet at once
    and the history is read from there, else they stay lazy frames.
    """

    def __init__(self, simulation_id: str, every: int = 1, most: int | None = None, folder: str | None = None, paths: list[str] | None = None):
        self.id, self.every, self.most, self.folder, self.paths = simulation_id, every, most, folder, paths
        self.tick, self.frames, self.spark = 0, [], None

    def __call__(self, state: DataFrame, time: float) -> None:
        self.spark, step = state.sparkSession, self.tick
        self.tick += 1
        if step % self.every:
            return
        rows = state if self.paths is None else query_paths(state, self.paths)
        rows = rows.select(F.lit(self.id).alias("simulation_id"), F.lit(step).cast("long").alias("step"), F.lit(float(time)).alias("global_time"), "*")
        if self.folder:
            write_parquet(rows, self.folder)
        else:
            self.frames.append(rows)
            if self.most:
                self.frames = self.frames[-self.most :]

    def history(self) -> DataFrame:
        if self.folder:
            rows = read_parquet(self.spark, self.folder, runs_wanted=[self.id])
            return rows if self.most is None else latest_steps(rows, self.most)
        out = self.frames[0]
        for f in self.frames[1:]:
            out = out.unionByName(f)
        return out


def latest_steps(history: DataFrame, most: int) -> DataFrame:
    """All rows of the last ``most`` recorded steps."""
    steps = history.select("step").distinct().orderBy(F.desc("step")).limit(most)
    return history.join(steps, "step", "left_semi")


def load_runs(history: DataFrame, catalogue: DataFrame, names: list[str] | None = None, run: str | None = None) -> DataFrame:
    """Observables of the catalogued runs (simulation_id, name), by name or id, in long form.

    Rows without a readable state give no observable; the filter is on the small side, before the join.
    """
    chosen = catalogue.select("simulation_id", "name")
    if names is not None:
        chosen = chosen.filter(F.col("name").isin(*names))
    if run is not None:
        chosen = chosen.filter(F.col("simulation_id") == run)
    return observables(history.join(chosen.select("simulation_id"), "simulation_id", "left_semi")).filter("value is not null")


def observable_units(spark: SparkSession, meta: dict[str, dict]) -> DataFrame:
    """(observable, units, label) from a study's description of its observables."""
    rows = [(k, m.get("units"), m.get("label", k)) for k, m in sorted(meta.items())]
    return spark.createDataFrame(rows, "observable string, units string, label string")


def gather(emitters: dict[str, Emitter], paths: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The history of every emitter by name, as lazy frames."""
    return {k: e.history() if not paths or k not in paths else query_paths(e.history(), paths[k]) for k, e in emitters.items()}


def stripped(df: DataFrame, paths: list[str]) -> DataFrame:
    """``df`` without these subtrees: a.b.c drops a field of a struct, a drops a column."""
    for p in paths:
        head, _, rest = p.partition(".")
        df = df.withColumn(head, F.col(head).dropFields(rest)) if rest else df.drop(head)
    return df


def without_nulls(column: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(column, lambda k, v: v.isNotNull())


def state_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., state): every row's other columns as JSON text, names in order."""
    rest = sorted(c for c in df.columns if c not in keys)
    return df.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("state"))
