"""Session helpers: reliable checkpoints and distributed row numbering."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings worth having on a large cluster; a caller's own values win.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def builder(app_name: str = "ionweave"):
    b = SparkSession.builder.appName(app_name)
    for key, value in RECOMMENDED_CONF.items():
        b = b.config(key, value)
    return b


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python tasks, wherever the driver was started."""
    sc, root = spark.sparkContext, str(Path(__file__).resolve().parents[1])
    if sc.master.startswith("local"):
        known = sc.environment.get("PYTHONPATH", "")
        if root not in known.split(":"):
            sc.environment["PYTHONPATH"] = f"{root}:{known}" if known else root
    elif not sc.environment.get("IONWEAVE_SHIPPED"):
        target = Path(tempfile.mkdtemp(prefix="ionweave-package-")) / "ionweave.zip"
        with zipfile.ZipFile(target, "w") as out:
            for file in Path(root, "ionweave").rglob("*.py"):
                out.write(file, file.relative_to(root))
        sc.addPyFile(str(target))
        sc.environment["IONWEAVE_SHIPPED"] = "1"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the cluster names it.

    A local folder is used only where none is named and the master is local.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="ionweave-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A written table of more rows takes part in joins by shuffles only.
BROADCAST_ROWS = 20_000


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder, read back.

    Unlike a checkpoint it has its real size.  A checkpoint keeps the size estimated for its plan, which every join multiplies, so
    that a loop of joins and checkpoints ends up estimating with numbers of millions of digits.
    Above ``BROADCAST_ROWS`` rows it isn't broadcast: compressed it passes as small, and a loop of joins would send it through
    the driver again and again.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return table.hint("merge") if table.count() > BROADCAST_ROWS else table


#: Rows of a table that one task gets when it is dealt out by a key.
TASK_ROWS = 300_000


def dealt_out(tables: dict[str, DataFrame], keys: dict[str, str], task_rows: int = TASK_ROWS) -> dict[str, DataFrame]:
    """Tables that meet by their keys, in as many partitions as keep the rows of a task bounded, however large they are.

    What is grouped or ranked by the key afterwards stays in these partitions; a fixed number of them, or one that follows the
    bytes shuffled, makes sorts and hash tables of a task grow with the input.  Small tables are left to the planner.
    """
    rows = max(df.count() for df in tables.values())
    if rows <= task_rows:
        return tables
    parts = max(-(-rows // task_rows), *(df.sparkSession.sparkContext.defaultParallelism for df in tables.values()))
    return {name: df.repartition(parts, keys[name]) for name, df in tables.items()}


def sorted_slices(df: DataFrame, *order: str) -> DataFrame:
    """Range-partition and sort by ``order``, then checkpoint.

    The partitions become fixed, contiguous slices of the global order.  A key that
    holds a large share of the rows is spread over several slices as long as the
    later order columns tell its rows apart.
    """
    return checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order))


def dense_positions(fixed: DataFrame, name: str = "pos") -> DataFrame:
    """Number the rows of a checkpointed table from 0, in the order of its partitions.

    Only one count per partition reaches the driver.
    """
    slices = fixed.withColumn("_mid", F.monotonically_increasing_id())
    slice_id = F.shiftright("_mid", 33)
    counts = {
        row["_slice"]: row["_n"]
        for row in slices.groupBy(slice_id.alias("_slice")).agg(F.count("*").alias("_n")).collect()
    }
    offsets, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(i, 0)
    if not offsets:
        offsets = [0]
    within = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    base = F.element_at(F.lit(offsets).cast("array<bigint>"), (slice_id + 1).cast("int"))
    return slices.withColumn(name, base + within).drop("_mid")


def ordered_index(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Add a dense 0-based position in the total order given by ``order``; no single task sees all rows."""
    return dense_positions(sorted_slices(df, *order), name)


def small_rows(df: DataFrame, max_rows: int):
    """``(count, local)``: the rows as a local, size-checked DataFrame.

    ``local`` is None when there are none or more than ``max_rows``; the count is then 0 or
    ``max_rows + 1``, and the rows that came are dropped.
    """
    rows = df.limit(max_rows + 1).collect()
    if not rows or len(rows) > max_rows:
        return len(rows), None
    return len(rows), df.sparkSession.createDataFrame(rows, df.schema)
