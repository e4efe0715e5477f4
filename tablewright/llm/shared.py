"""Tables that outlive their executors, and column picking that no extra column can disturb."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import StorageError
from tablewright.session import checkpoint_dir

#: A word, in every operator of this package: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rank of a row whose doc_id is null: after every number.
LAST_ID = 2**63 - 1

_folders: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``; a local one only in local mode."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = checkpoint_dir(spark)
        if base is None:
            if not spark.sparkContext.master.startswith("local["):
                raise StorageError("set spark.checkpoint.dir to a folder all executors can reach")
            local = tempfile.TemporaryDirectory(prefix="tablewright-", ignore_cleanup_errors=True)
            atexit.register(local.cleanup)
            base = local.name
        _folders[app] = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
    return _folders[app]


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that nothing before it runs again."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; a missing one is null. Whatever else the table has is dropped."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(df[f"`{have[n]}`"] if n in have else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
