"""Session settings, lineage cuts and size-checked broadcasts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows, and of bytes as JSON, of a side that may be broadcast after its size was checked.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 32 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leakscope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application.

    The archive lies with the driver, whose file server hands it to every executor, new ones included.
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _SHIPPED or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="leakscope-code-")) / "leakscope_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, Path(package.name) / source.relative_to(package))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir.

    Only a local master gets a temporary folder; on a cluster a machine-local
    folder would be lost with its machine, so its absence is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="leakscope-checkpoint-")
    context.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and go on from those files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the side has at most max_rows rows and BROADCAST_BYTES bytes.

    Larger sides come back unhinted, so the join is then a shuffle join. The
    count reads no more than max_rows + 1 rows.
    """
    size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found.n <= max_rows and found.size <= BROADCAST_BYTES else df


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """broadcast_if_small of a frame that is derived: it is written down first, so counting does not compute it twice."""
    return broadcast_if_small(cut_lineage(df), max_rows)


def scratch(spark: SparkSession) -> str:
    """A new folder for tables a plan writes and reads again, beside the checkpoints and so shared like them."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_rows(df: DataFrame, key: str | list[str], received: str = "ingested_at", columns: list[str] | None = None) -> DataFrame:
    """One row of every key: the one received last.

    Rows received at the same time (or all without a time, which counts as the
    earliest) are told apart by the other columns, so the result does not
    depend on the partitioning. Rows with a null key are kept as one group.
    """
    keys = [key] if isinstance(key, str) else list(key)
    columns = [c for c in (columns or df.columns) if c not in keys]
    ordered = F.struct(*[F.col(c) for c in [received, *[c for c in columns if c != received]]])
    last = df.groupBy(*keys).agg(F.max(ordered).alias("last_row"))
    return last.select(*keys, *[F.col(f"last_row.{c}").alias(c) for c in columns])
