"""A layered paper store on Parquet: one table for each layer, contents, an index and named collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAYERS = ["L0", "L1", "L2", "L3"]
OPEN = ["gold", "green", "hybrid", "bronze"]


def _versions(spark: SparkSession, path: str) -> tuple[object, list[tuple[int, str, bool]]]:
    """The file system and (number, folder, whether it is complete) of a table's versions, oldest first."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    found = sorted((int(n[2:]), f"{path}/{n}") for n in names if n.startswith("v-"))
    return fs, [(k, f, fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS"))) for k, f in found]


def _replace(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write the table's next version. A version counts once the mark of its end is there, which Spark writes last: readers see the
    old rows or the new ones, and a writer that dies leaves the old. Two writers of one version: the second raises. The version before stays for its readers."""
    fs, found = _versions(spark, path)
    number = found[-1][0] + 1 if found else 1
    df.write.mode("error").parquet(f"{path}/v-{number:08d}")
    whole = [f for _, f, done in found if done]
    for _, folder, _done in found:
        if folder not in whole[-1:]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)


class Store:
    """Rows are (doi, data string) a layer; saving replaces the rows of the identifiers given."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        whole = [f for _, f, done in _versions(self.spark, f"{self.root}/{name}")[1] if done]
        return self.spark.read.parquet(whole[-1]) if whole else self.spark.createDataFrame([], schema)

    def _upsert(self, name: str, schema: str, rows: DataFrame, keys: list[str]) -> None:
        old = self._table(name, schema)
        _replace(self.spark, old.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows), f"{self.root}/{name}")

    def save_layer(self, layer: str, rows: DataFrame) -> None:
        if layer not in LAYERS:
            raise ValueError(f"no layer {layer}")
        self._upsert(layer, "doi string, data string", rows.select("doi", "data"), ["doi"])

    def load_layer(self, layer: str) -> DataFrame:
        return self._table(layer, "doi string, data string")

    def save_content(self, rows: DataFrame) -> None:
        """rows(doi, kind, content binary)."""
        self._upsert("content", "doi string, kind string, content binary", rows.select("doi", "kind", "content"), ["doi", "kind"])

    def load_content(self, kind: str) -> DataFrame:
        return self._table("content", "doi string, kind string, content binary").where(F.col("kind") == kind)

    def save_index(self, rows: DataFrame) -> None:
        """rows(doi, title, year, oa_status, method): new values win, old ones stay where the new are null."""
        schema = "doi string, title string, year int, oa_status string, method string, added date"
        old = self._table("index", schema)
        _replace(self.spark, merged_index(old, rows), f"{self.root}/index")

    def index(self) -> DataFrame:
        """The index with a flag for each layer that holds the paper."""
        rows = self._table("index", "doi string, title string, year int, oa_status string, method string, added date")
        for layer in LAYERS:
            rows = rows.join(self.load_layer(layer).select("doi", F.lit(True).alias(layer)), "doi", "left").withColumn(layer, F.coalesce(layer, F.lit(False)))
        return rows

    def collect(self, name: str, dois: DataFrame) -> None:
        """Add identifiers to a collection; it is made if there is none."""
        rows = dois.select(F.lit(name).alias("name"), "doi").distinct()
        old = self._table("collections", "name string, doi string")
        _replace(self.spark, old.unionByName(rows).distinct(), f"{self.root}/collections")

    def collection(self, name: str) -> DataFrame:
        return self._table("collections", "name string, doi string").where(F.col("name") == name).select("doi")

    def collections(self) -> DataFrame:
        return self._table("collections", "name string, doi string").groupBy("name").agg(F.count("*").alias("n"))

    def export(self, name: str | None = None) -> DataFrame:
        rows = self.load_layer("L0")
        return rows.join(self.collection(name), "doi", "left_semi") if name else rows


def merged_index(old: DataFrame, new: DataFrame) -> DataFrame:
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.doi") == F.col("b.doi"), "full")
    return both.select(F.coalesce("b.doi", "a.doi").alias("doi"), *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in ("title", "year", "oa_status", "method")], F.coalesce("a.added", F.current_date()).alias("added"))


def listed(index: DataFrame, year_min: int | None = None, year_max: int | None = None, open_only: bool = False, layer: str | None = None) -> DataFrame:
    """Papers of the index by year (unknown years pass), open access and layer."""
    out = index
    if year_min is not None:
        out = out.where(F.col("year").isNull() | (F.col("year") >= year_min))
    if year_max is not None:
        out = out.where(F.col("year").isNull() | (F.col("year") <= year_max))
    if open_only:
        out = out.where(F.col("oa_status").isin(OPEN))
    return out.where(F.col(layer)) if layer else out


def stats(index: DataFrame) -> DataFrame:
    """what, value, n: papers in all, by layer, by method and by open-access status."""
    one = index.agg(F.count("*").alias("n"), *[F.count_if(F.col(x)).alias(x) for x in LAYERS])
    layers = one.select(F.explode(F.array(F.struct(F.lit("all").alias("value"), F.col("n").alias("n")), *[F.struct(F.lit(x).alias("value"), F.col(x).alias("n")) for x in LAYERS])).alias("s")).select(F.lit("layer").alias("what"), "s.*")
    by = lambda c: index.groupBy(F.coalesce(c, F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("what"), "value", "n")
    return layers.unionByName(by("method")).unionByName(by("oa_status"))


def card(doi, title, year, abstract):
    """A paper's text card."""
    return F.format_string("# %s\n\n- DOI: %s\n- Year: %s\n\n%s\n", F.coalesce(title, F.lit("Untitled")), doi, F.coalesce(year.cast("string"), F.lit("unknown")), F.coalesce(abstract, F.lit("")))


def write_json_map(rows: DataFrame, key: str, value: str, path: str) -> None:
    """One JSON object {key: value} in one file: a partition's map as clients expect it, for results of modest size."""
    one = rows.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value)))))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def write_bridges_csv(bridges: DataFrame, path: str) -> None:
    """Bridges with a fixed order of columns and lists joined by semicolons."""
    cols = ["cluster_a", "cluster_b", "entity_jaccard", "shared_count", "unique_a", "unique_b"]
    bridges.select(*cols, F.array_join("shared_entities", ";").alias("shared_entities")).orderBy("cluster_a", "cluster_b").write.mode("overwrite").option("header", True).csv(path)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("rn = 1").drop("rn")
