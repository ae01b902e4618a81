"""Connected components of an edge table, without collecting nodes or links."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Python workers get rows by a few MB.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: Held while a table is stored: besides, shuffles are freed at the end.
WHILE_STORED = SMALL_BATCHES | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session's own in the one named by spark.checkpoint.dir (where it is unset, a temporary one in local mode, else an error)."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, cut from its lineage, in the folder named by spark.checkpoint.dir (a temporary one only where it is unset)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Sets SMALL_BATCHES for the session, so that a frame which is run later keeps to them too."""
    for k, v in SMALL_BATCHES.items():
        spark.conf.set(k, v)


def stored(df: DataFrame, name: str, compression: str = "uncompressed") -> DataFrame:
    """df, written as Parquet to a folder of its own below shared_folder and read back; what it shuffled is freed at once.

    Most such tables hold hashes or compressed packs: pages end by size, checked at each row, as a hundred packs would be a page of tens of MB.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WHILE_STORED}
    try:
        for k, v in WHILE_STORED.items():
            spark.conf.set(k, v)
        df.write.option("parquet.page.size.row.check.min", "1").option("parquet.page.size.row.check.max", "100").parquet(path, compression=compression)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that stored gave; nothing may read it later."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Links of a node that one task takes at least; HUBS such nodes at most are told to all tasks.
HUB, HUBS = 256, 1 << 15


def tied(rows: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """rows (a, b) with m of a: least has (a, m, n), n at least the number of a's rows. Nodes over limit are dealt to more tasks, with m for each."""
    hubs = least.where(f"n > {limit} and m is not null").select("a", F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(hubs), "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int"))
    least = least.withColumn("part", F.explode(F.expr(f"sequence(0, int(ceil(n / {limit})) - 1)"))).select("a", "part", "m")
    return rows.join(least, ["a", "part"]).select("a", "b", "m")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node in edges (a, b): root is the smallest node reachable.

    Alternates two steps on links from larger to smaller nodes: each node's larger neighbours are tied to its
    smallest one, then its smaller ones are. Each step sums up before it shuffles, and a hub's links are dealt to several
    tasks: over HUB links, or in large tables over as many as leave HUBS hubs.
    Self links are kept as lone nodes; an empty table gives an empty one.
    """
    edges = checkpointed(edges)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = checkpointed(links), None
    n = links.count()
    for _ in range(rounds):
        both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        limit = max(HUB, -(-2 * n // HUBS))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = tied(both.where("b > a"), least, limit).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = tied(large, least, limit)
        links = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        links = checkpointed(links)
        now = links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.countDistinct("b")).first()
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
