"""Session helpers shared by every operator: configuration, table access, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on. Shuffle partition counts are left to the session and AQE.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(cores: int = 8, app: str = "lodestack", **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = {
        **RUNTIME,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        **extra,
    }
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each context, so that Python operators run on any cluster."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestack_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.suffix != ".zip" and root.is_dir():
        target = Path(tempfile.mkdtemp(prefix="lodestack-ship-")) / "lodestack_package.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        sc.addPyFile(str(target))
    sc._lodestack_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make a folder only where none is set (local tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestack-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut lineage in the shared checkpoint folder, which outlives any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_in_loop(df: DataFrame) -> DataFrame:
    """As cut, without the plan's size estimate, which joins multiply: in a loop its digits double each round."""
    done, spark = cut(df), df.sparkSession
    try:
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)
    except (AttributeError, TypeError):  # sessions without this JVM call keep the estimate
        return done


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly before a step whose work is far larger than its bytes, so that AQE does not gather them in few tasks."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n)
