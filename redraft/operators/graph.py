"""Reachability over dependency edges (child, parent)."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_ROUNDS = 1000
#: Rounds by one edge each, before what is left to reach is sought in a contracted graph.
NEAR_ROUNDS = 6
#: How many times as many edges as at first contraction may leave.
MOST_GROWTH = 8
#: Edges of a node that contraction may take out, and in- times out-edges beyond their sum; few enough nodes are left to rounds.
MOST_DEGREE, MOST_PAIRS, FEW = 8, 9, 8
#: Rounds of contraction; one takes a third of a chain.
MOST_CONTRACTIONS = 100
#: As many walks as this are cut into blocks where contraction has left them.
BLOCKS_FROM = 100_000
#: Walks that start in a block, at least and at most, and the nodes by which it may be entered; rounds in which groups join.
LEAST_BLOCK, MOST_BLOCK, MOST_ENTRIES, MOST_JOININGS = 1_000, 2_000_000, 64, 12


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; where that is unset, as in tests, a local session gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not named:
            import tempfile

            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Behind a checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


class Store:
    """Tables of one run in the shared folder, read back as they were written; the next of a name takes the place of the one before, and all go at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, f"{checkpoint_folder(spark)}/run-{uuid.uuid4().hex}", 0
        self.paths: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.count += 1
        path, before = f"{self.folder}/{self.count}", self.paths.get(name)
        df.write.parquet(path)
        self.paths[name] = path
        if before:
            self.drop(before)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        """A result behind a checkpoint of its own; all tables go."""
        out = saved(df)
        self.drop(self.folder)
        return out

    def drop(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def union_saved(parts: list[DataFrame]) -> DataFrame:
    """The union of tables of the same columns behind a checkpoint.  Each is written to the shared folder first and planned on its own; those files go when the union is saved."""
    spark = parts[0].sparkSession
    folder = f"{checkpoint_folder(spark)}/union-{uuid.uuid4().hex}"
    for number, part in enumerate(parts):
        part.write.parquet(f"{folder}/{number}")
    schema = parts[0].schema
    out = saved(reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{folder}/{n}").select(*schema.names) for n in range(len(parts))]))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def dependents(edges: DataFrame, target: str) -> DataFrame:
    """(node): those that depend on the target directly."""
    return edges.where((F.col("child") == target) & (F.col("parent") != target)).select(F.col("parent").alias("node")).distinct()


def ancestors(edges: DataFrame, target: str) -> DataFrame:
    """(node, depth): all that depend on the target, at the least distance; the target itself is never passed through."""
    one = edges.select(F.lit("").alias("file"), "child", "parent")
    targets = edges.sparkSession.createDataFrame([("", target)], "file string, target string")
    return ancestors_of(one, targets).select("node", "depth")


def ancestors_of(edges: DataFrame, targets: DataFrame, most_growth: int = MOST_GROWTH) -> DataFrame:
    """(file, target, node, depth): in each file's edges (file, child, parent) all that depend on the targets (file, target), at the least distance.

    What is near is found by a few rounds of an edge each.  Files that are not done by then are contracted: nodes of few edges that are no neighbours leave the graph all at once, and
    edges past them take their places, as long as those they were.  So chains of any length and graphs that are narrow shrink by a fraction each time.  Where many edges are left, dense parts that few
    nodes lead into become blocks, and edges from those nodes past the block take its place.  What does not shrink is searched by rounds,
    and the nodes that left come back in the reverse order, each by the edges that it had.  Contraction ends where most_growth times the edges would be passed; 0 never contracts.
    A target counts as reached from the start, so it is never passed through, and cycles end there or where all is reached.
    """
    store = Store(edges.sparkSession)
    targets = store.put("targets", targets.select("file", "target").distinct())
    own = edges.where("child <> parent").select("file", F.col("child").alias("node"), F.col("parent").alias("to")).distinct()
    walks = store.put("walks", own.join(targets.select("file").distinct(), "file", "left_semi").select("*", F.lit(1).alias("far")))
    reached, open_files = _rounds(store, walks, targets, NEAR_ROUNDS if most_growth else MOST_ROUNDS)
    if open_files is None:
        return store.last(reached.where("depth > 0"))
    done = store.put("done", reached.join(open_files, "file", "left_anti"))
    targets = store.put("targets", targets.join(open_files, "file", "left_semi"))
    walks = store.put("walks", walks.join(open_files, "file", "left_semi"))
    walks, taken = _contracted(store, walks, targets, most_growth)
    reached = _through_blocks(store, walks, targets, most_growth) if most_growth and walks.count() >= BLOCKS_FROM else _all_rounds(store, walks, targets)
    return store.last(done.unionByName(_back(store, reached, taken)).where("depth > 0"))


def _all_rounds(store: Store, walks: DataFrame, targets: DataFrame) -> DataFrame:
    reached, open_files = _rounds(store, walks, targets, MOST_ROUNDS)
    if open_files is not None:
        raise RuntimeError("too many rounds")
    return reached


def _back(store: Store, reached: DataFrame, taken: list[DataFrame]) -> DataFrame:
    """What is reached, with the nodes that left."""
    for layer in reversed(taken):
        back = layer.join(reached.withColumnRenamed("node", "before"), ["file", "before"]).groupBy("file", "target", "node").agg(F.min(F.col("depth") + F.col("far")).alias("depth"))
        reached = store.put("reached", reached.unionByName(back))
    return reached


def _rounds(store: Store, walks: DataFrame, targets: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(file, target, node, depth) that most rounds over walks (file, node, to, far) reach, and the files in which the last round found something, if any did."""
    keys = ["file", "target", "node"]
    reached = front = store.put("reached", targets.select("file", "target", F.col("target").alias("node"), F.lit(0).alias("depth")))
    for _ in range(most):
        met = front.join(walks, ["file", "node"]).groupBy("file", "target", F.col("to").alias("node")).agg(F.min(F.col("depth") + F.col("far")).alias("depth"))
        front = store.put("front", met.join(reached.withColumnRenamed("depth", "known"), keys, "left").where("known is null or depth < known").select(*keys, "depth"))
        if front.isEmpty():
            return reached, None
        reached = store.put("reached", reached.unionByName(front).groupBy(*keys).agg(F.min("depth").alias("depth")))
    return reached, front.select("file").distinct()


def _contracted(store: Store, walks: DataFrame, targets: DataFrame, most_growth: int) -> tuple[DataFrame, list[DataFrame]]:
    """Walks (file, node, to, far) without the nodes that could leave, and for each round those that left, with the walks to them (file, node, before, far).

    Of neighbours at most one leaves, by the least hash of the round; targets stay.
    """
    most, taken = most_growth * walks.count(), []
    kept = targets.select("file", F.col("target").alias("node")).distinct()
    for number in range(MOST_CONTRACTIONS):
        ends = walks.select("file", "node", F.col("to").alias("other"), F.lit(0).alias("come")).unionByName(walks.select("file", F.col("to").alias("node"), F.col("node").alias("other"), F.lit(1).alias("come")))
        place = lambda c: F.xxhash64("file", c, F.lit(number))
        sizes = ends.groupBy("file", "node").agg(F.sum("come").alias("come"), F.count("*").alias("all"), F.min(place("other")).alias("least"))
        pairs = F.col("come") * (F.col("all") - F.col("come"))
        able = sizes.where((F.col("all") <= MOST_DEGREE) & (pairs <= F.greatest(F.col("all"), F.lit(MOST_PAIRS)))).join(kept, ["file", "node"], "left_anti")
        able = store.put("able", able.select("file", "node", (place("node") < F.col("least")).alias("leaves")))
        if able.count() <= FEW:
            break
        out = able.where("leaves").select("file", "node")
        arrive = walks.join(out.withColumnRenamed("node", "to"), ["file", "to"], "left_semi")
        layer = store.put(f"layer {store.count}", arrive.select("file", F.col("to").alias("node"), F.col("node").alias("before"), "far"))
        leave = walks.join(out, ["file", "node"], "left_semi").select("file", "node", "to", F.col("far").alias("on"))
        past = layer.join(leave, ["file", "node"]).where("before <> to").select("file", F.col("before").alias("node"), "to", (F.col("far") + F.col("on")).alias("far"))
        rest = walks.join(out, ["file", "node"], "left_anti").join(out.withColumnRenamed("node", "to"), ["file", "to"], "left_anti")
        shorter = store.put("shorter", rest.unionByName(past).groupBy("file", "node", "to").agg(F.min("far").alias("far")))
        taken.append(layer)
        walks = store.put("walks", shorter)
        if walks.count() > most:
            break
    return walks, taken


def _through_blocks(store: Store, walks: DataFrame, targets: DataFrame, most_growth: int) -> DataFrame:
    """(file, target, node, depth) over walks (file, node, to, far), the searches between blocks made before those within.

    Any cut into blocks gives the same depths.  A block that few nodes lead into is left out of the search but for these: walks from them to all that the block leads to take its place.
    Then each block is searched once more from the depths at which it was entered.
    """
    hashed = lambda c: F.xxhash64("file", c)
    ends = walks.select("file", "node", hashed("to").alias("on"), F.lit(None).cast("long").alias("by")).unionByName(walks.select("file", F.col("to").alias("node"), F.lit(None).cast("long").alias("on"), hashed("node").alias("by")))
    grouped = ends.groupBy("file", "node").agg(F.coalesce(F.min("on"), F.min("by")).alias("group"))
    nodes = store.put("nodes", grouped.select("file", "node", "group", F.monotonically_increasing_id().alias("id")))
    end = lambda name, id_, group: nodes.select("file", F.col("node").alias(name), F.col("id").alias(id_), F.col("group").alias(group))
    links = store.put("links", walks.join(end("node", "a", "ga"), ["file", "node"]).join(end("to", "b", "gb"), ["file", "to"]).select("file", "a", "b", "far", "ga", "gb"))
    homes, sizes = _homes(store, links)
    home = lambda group, name: homes.select(F.col("group").alias(group), F.col("home").alias(name))
    placed = store.put("links", links.join(home("ga", "home"), "ga").join(home("gb", "into"), "gb").select("file", "a", "b", "far", "home", "into"))
    own = targets.join(end("target", "id", "group"), ["file", "target"]).join(homes, "group").select("file", "target", "id", "home")
    own = store.put("own", own)
    entries = store.put("entries", placed.where("home <> into").select("file", F.col("into").alias("home"), F.col("b").alias("node")).unionByName(own.select("file", "home", F.col("id").alias("node"))).distinct())
    few = entries.groupBy("home").agg(F.count("*").alias("n")).where(F.col("n") <= MOST_ENTRIES)
    closed = store.put("closed", sizes.where(F.col("size").between(LEAST_BLOCK, MOST_BLOCK)).join(few, "home").select("home"))
    entries = store.put("entries", entries.join(closed, "home"))
    inner = placed.join(closed, "home").select("home", "a", "b", "far", (F.col("home") == F.col("into")).alias("inside"))
    across = inner.groupBy("home").cogroup(entries.groupBy("home")).applyInPandas(_past_block, "file string, node long, to long, far int")
    outer = store.put("walks", placed.join(closed, "home", "left_anti").select("file", F.col("a").alias("node"), F.col("b").alias("to"), "far").unionByName(across))
    starts = store.put("targets by id", own.select("file", F.col("id").alias("target")))
    outer, taken = _contracted(store, outer, starts, most_growth)
    reached = _back(store, _all_rounds(store, outer, starts), taken)
    entered = reached.join(entries, ["file", "node"]).select("home", "file", "target", "node", "depth")
    within = inner.groupBy("home").cogroup(entered.groupBy("home")).applyInPandas(_in_block, "file string, target long, node long, depth int")
    found = reached.join(entries, ["file", "node"], "left_anti").unionByName(within).select("file", F.col("target").alias("goal"), F.col("node").alias("id"), "depth")
    named = found.where("depth > 0").join(own.select("file", "target", F.col("id").alias("goal")), ["file", "goal"]).join(nodes, ["file", "id"])
    # a target all of whose edges left with its neighbours is in no block
    return store.put("reached", named.select("file", "target", "node", "depth").unionByName(targets.select("file", "target", F.col("target").alias("node"), F.lit(0).alias("depth"))))


def _homes(store: Store, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group, home) and (home, size): groups of links (ga, gb) that have most links with each other share a home, while it has few enough links and many ways into it."""
    pairs = store.put("pairs", links.where("ga <> gb").groupBy(F.col("ga").alias("home"), F.col("gb").alias("other")).agg(F.count("*").alias("weight")))
    each = links.select(F.col("ga").alias("home"), F.lit(1).alias("n")).unionByName(links.select(F.col("gb").alias("home"), F.lit(0).alias("n")))
    sizes = store.put("sizes", each.groupBy("home").agg(F.sum("n").alias("size")))
    homes = store.put("homes", sizes.select(F.col("home").alias("group"), "home"))
    for _ in range(MOST_JOININGS):
        into = pairs.groupBy(F.col("other").alias("home")).agg(F.sum("weight").alias("ways"))
        able = store.put("able", sizes.join(into, "home", "left").where((F.col("size") < LEAST_BLOCK) | (F.col("ways") > MOST_ENTRIES)).select("home", "size"))
        both = pairs.unionByName(pairs.select(F.col("other").alias("home"), F.col("home").alias("other"), "weight")).groupBy("home", "other").agg(F.sum("weight").alias("weight"))
        met = both.join(able, "home").join(able.select(F.col("home").alias("other"), F.col("size").alias("held")), "other").where(F.col("size") + F.col("held") <= MOST_BLOCK)
        best = met.groupBy("home", "size").agg(F.max(F.struct("weight", "held", "other")).alias("b")).select("home", "size", "b.*").where("held > size or held = size and other > home")
        best = store.put("best", best)
        # the larger one stays, if it does not itself join another; those that it has most links with come first
        joins = best.join(best.select(F.col("home").alias("other")), "other", "left_anti")
        room = F.sum("size").over(Window.partitionBy("other").orderBy(F.desc("weight"), "home").rowsBetween(Window.unboundedPreceding, 0)) + F.col("held") <= MOST_BLOCK
        joins = store.put("joins", joins.withColumn("room", room).where("room").select("home", F.col("other").alias("next")))
        if joins.isEmpty():
            break
        moved = lambda df, column: df.join(joins.withColumnRenamed("home", column), column, "left").withColumn(column, F.coalesce("next", column)).drop("next")
        homes, sizes = store.put("homes", moved(homes, "home")), store.put("sizes", moved(sizes, "home").groupBy("home").agg(F.sum("size").alias("size")))
        pairs = store.put("pairs", moved(moved(pairs, "home"), "other").where("home <> other").groupBy("home", "other").agg(F.sum("weight").alias("weight")))
    return homes, sizes


class _Block:
    """The links (a, b, far, inside) of a block, for searches from its entries (node)."""

    def __init__(self, links: pd.DataFrame, entries: pd.DataFrame):
        inside = links["inside"].to_numpy("bool")
        a, b, far = (links[c].to_numpy("int64") for c in ("a", "b", "far"))
        self.ids = np.unique(np.concatenate([a, b[inside], entries["node"].to_numpy("int64")]))
        a = self.places(a)
        self.out = a[~inside], b[~inside], far[~inside]
        order = np.argsort(a[inside], kind="stable")
        self.to, self.far = self.places(b[inside][order]), far[inside][order]
        self.first = np.searchsorted(a[inside][order], np.arange(len(self.ids) + 1))

    def places(self, nodes) -> np.ndarray:
        return np.searchsorted(self.ids, nodes)

    def depths(self, nodes, known) -> np.ndarray:
        """The least depth of each of ids from nodes of known depth; a negative one where it is not reached."""
        none = np.iinfo("int64").max
        depth = np.full(len(self.ids), none)
        front = self.places(nodes)
        depth[front] = known
        while len(front):
            begin, count = self.first[front], self.first[front + 1] - self.first[front]
            link = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
            to, new = self.to[link], np.repeat(depth[front], count) + self.far[link]
            nearer = new < depth[to]
            to = to[nearer]
            np.minimum.at(depth, to, new[nearer])
            front = np.unique(to)
        return np.where(depth == none, -1, depth)


def _past_block(links: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """Walks (file, node, to, far) from each entry (file, node) of a block to all that its links lead to outside."""
    block, found = _Block(links, entries), []
    a, b, far = block.out
    for file, node in zip(entries["file"], entries["node"]):
        depth = block.depths([node], 0)[a]
        ways = pd.DataFrame({"to": b, "far": depth + far})[depth >= 0].groupby("to", as_index=False)["far"].min()
        found.append(ways.assign(file=file, node=node))
    return pd.concat(found)[["file", "node", "to", "far"]]


def _in_block(links: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
    """(file, target, node, depth) of a block's nodes from the depths (file, target, node, depth) of its entries."""
    if entered.empty:
        return pd.DataFrame({"file": [], "target": [], "node": [], "depth": []}).astype({"file": "str", "target": "int64", "node": "int64", "depth": "int32"})
    block, found = _Block(links, entered), []
    for (file, target), own in entered.groupby(["file", "target"]):
        depth = block.depths(own["node"], own["depth"])
        found.append(pd.DataFrame({"file": file, "target": target, "node": block.ids, "depth": depth})[depth >= 0])
    return pd.concat(found)
