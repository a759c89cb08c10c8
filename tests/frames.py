"""What several test modules read off a DataFrame or the session."""

import os
import time


def shuffle_files(spark, most: int = 0) -> int:
    """Shuffle files on disk; waits a little until there are no more than ``most``, as Spark deletes them in the background."""
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    for _ in range(50):
        n = sum(f.startswith("shuffle_") and f.endswith(".data") for top in folders for _, _, names in os.walk(top) for f in names)
        if n <= most:
            break
        time.sleep(0.1)
    return n


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df, *columns):
    return sorted(
        (tuple(r) for r in df.select(*(columns or df.columns)).collect()),
        key=lambda row: tuple((v is not None, str(v)) for v in row),
    )
