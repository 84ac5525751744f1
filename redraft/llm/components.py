"""Tables in the shared folder, and connected components of a graph of document ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds double the reach of a label, so this many are far more than any graph needs.
MOST_ROUNDS = 60


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.  Where it is unset a local session, as in tests, gets a folder of its own; a cluster has to name one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def saved(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete what an operator wrote to the shared folder and needs no more, in whatever store that is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """The tables that one run of an operator writes to the shared folder, where they cut lineage and plans; deleted one by one or all together."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[str, str] = {}

    def saved(self, df: DataFrame, name: str = "") -> DataFrame:
        """df, written and read again; a table of the same name that was written before goes."""
        self.count += 1
        path, before = f"{self.folder}/{self.count}", self.paths.get(name)
        df.write.parquet(path)
        if name:
            self.paths[name] = path
            if before:
                drop_folder(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        """A result behind a checkpoint of its own; all tables go."""
        out = saved(df)
        self.drop()
        return out

    def drop(self) -> None:
        drop_folder(self.spark, self.folder)


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every id in edges (a, b), by alternating large and small stars; the component's id is its smallest id.

    Edges may repeat, point either way or join an id to itself; null ends are left out.  No edges give no rows.
    """
    tables = Tables(edges.sparkSession, "components")
    ends = edges.where("a is not null and b is not null").select("a", "b")
    ends = tables.saved(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "ends")
    now = tables.saved(ends.where("u <> v"), "now")
    before = None
    for _ in range(MOST_ROUNDS):
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        wide = tables.saved(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "wide")
        # small star: u and its smaller neighbours move to the smallest of them
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        moved = wide.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = tables.saved(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "now")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("doc_id")).unionByName(ends.where("u = v").select(F.col("u").alias("doc_id"))).distinct()
    roots = roots.join(now.select(F.col("u").alias("doc_id")), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("component_id"))
    return tables.last(now.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).unionByName(roots))
