"""Session helpers: table loading, lineage cuts, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, of a side that may be broadcast.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    The cluster names its shared folder in spark.checkpoint.dir; it is only set
    here, to a folder of this machine, where nothing is configured and the master is
    this machine itself.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="scoria-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def store(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written once as a table in the checkpoint folder and read back.

    A checkpoint of the session does the same but computes the rows twice; later reads of a table also take only the
    columns and row groups that they need. Tables stay until the folder is cleared, as results may be read late.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/scoria-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, limit: int | None = None) -> bool:
    """Whether a materialized side is small enough to be broadcast, by its measured size.

    The size is an upper estimate from the rows' own text forms, in one aggregate over
    data that is already cut or tiny.
    """
    size = F.lit(0)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "string":
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + 24
        elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp"):
            size = size + 16
        else:
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) * 2 + 24
    total = df.agg(F.sum(size.cast("bigint")).alias("b")).first()["b"] or 0
    return total <= (BROADCAST_BYTES if limit is None else limit)


def small(df: DataFrame) -> DataFrame:
    """Mark a materialized side for broadcast if its measured size allows it; beyond the limit the join shuffles."""
    return F.broadcast(df) if fits(df) else df


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names, each free in df: the wanted name with underscores in front as needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
