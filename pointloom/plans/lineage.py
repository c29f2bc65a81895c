"""Cuts the lineage of loops."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame

#: Estimated bytes beyond which an estimate is dropped: what Spark takes where it knows nothing.
UNKNOWN_SIZE = 2**63 - 1


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that the cluster names in spark.checkpoint.dir; in local mode, where it is unset, in one of our own, which goes at exit.

    A checkpoint keeps the estimated size of the plan behind it, and a join's is the product of its sides'. In a loop whose rounds join what the last one made, the estimate's
    digits multiply with each round until the driver is full, so one that says nothing any more isn't kept.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="pointloom-")
            atexit.register(shutil.rmtree, own, True)
            place = f"file://{own}"
        spark.sparkContext.setCheckpointDir(place)
    out = df.checkpoint()
    query = out._jdf.queryExecution()
    if query.optimizedPlan().stats().sizeInBytes() > UNKNOWN_SIZE:
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(query.toRdd(), out._jdf.schema(), False), spark)
    return out
