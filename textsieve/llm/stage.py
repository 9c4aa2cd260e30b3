"""Written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship

#: Used only where the session names no folder and all runs on one machine, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints"
KEY = ["__ts_id", "__ts_h1", "__ts_h2"]


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Without one there is a default on a single machine, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_DEFAULT).rstrip("/")


def staged_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/textsieve/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again.

    A lost executor costs only the tasks it was running: whatever reads the
    table afterwards depends on the files and not on the plan that made them.
    """
    spark = df.sparkSession
    path = f"{staged_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Deletes the staged tables of this application, once the frames that read them are done with."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds KEY: the id and 128 bits of hash of the text.

    Rows equal in both share a key, and every operator gives such rows equal
    results, so a join on KEY from a side that is distinct in it is exact even
    where ids repeat.
    """
    return df.withColumns({"__ts_id": F.col(id_col), "__ts_h1": F.xxhash64(text_col), "__ts_h2": F.xxhash64(F.lit(7), F.col(text_col))})


def join_on_key(left: DataFrame, right: DataFrame, how: str = "left", keys: list[str] | None = None) -> DataFrame:
    """Joins on keys with nulls equal; right's keys go, its other columns stay."""
    keys = keys or KEY
    other = right.withColumnsRenamed({k: f"{k}_r" for k in keys})
    on = None
    for k in keys:
        eq = left[k].eqNullSafe(other[f"{k}_r"])
        on = eq if on is None else on & eq
    return left.join(other, on, how).drop(*[f"{k}_r" for k in keys])


#: Keys that join_counted may broadcast, at most.
MAX_HOT, LEAST_HOT = 2000, 1000


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], rows: str, how: str = "inner", cold: str | None = None) -> DataFrame:
    """Inner or left join of big with small, which has each key once and in column rows how many rows of big have it, or more.

    A key with more than a MAX_HOT-th of the rows is hot; there are fewer than
    MAX_HOT of them, whatever the data, so these are broadcast and their rows stay
    where they are. The rest is shuffled without them, and no key is large there.
    small is read several times and should be a table. cold: a join hint for the
    rest, where the plan is not to depend on small's size.
    """
    total = small.agg(F.sum(rows)).first()[0] or 0
    limit = max(LEAST_HOT, total // MAX_HOT)
    hot = F.broadcast(small.where(F.col(rows) > limit))
    few = small.where(F.col(rows) <= limit)
    rest = big.join(hot.select(*keys), keys, "left_anti").join(few.hint(cold) if cold else few, keys, how)
    return big.join(hot, keys).unionByName(rest)


def fields(df: DataFrame, keep: list[str], new: str) -> StructType:
    """The columns keep of df as they are, then those of the DDL string new."""
    return StructType([df.schema[c] for c in keep] + StructType.fromDDL(new).fields)


def map_arrow(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """df.mapInArrow where run may refer to this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
