"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "memspark") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


#: Bytes beyond which a table's estimated size is no estimate.
MOST_SIZE = 1 << 62
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on (naive UTC timestamps) and the state store that custom stream state needs."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(shared)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it with its lineage cut.

    Used where a frame is read several times and recomputing it would be wrong (partition ids) or
    slow (iterations). The files are reliable storage, so a lost executor costs a re-read only.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return _sized(df.checkpoint(eager=True))


def _sized(df: DataFrame) -> DataFrame:
    """``df``, just written, without a size estimate that no table can have.

    A written frame hands on the size that was estimated for its plan, and a join's is the product of its sides'. In a
    loop of joins that number's digits double in each round; the driver soon spends its time and memory on multiplying.
    """
    plan = df._jdf.queryExecution()
    if plan.analyzed().stats().sizeInBytes() < MOST_SIZE:
        return df
    return DataFrame(df._jdf.sparkSession().internalCreateDataFrame(plan.toRdd(), df._jdf.schema(), False), df.sparkSession)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows. Stops counting just past the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer partitions than there are cores; leave any larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
