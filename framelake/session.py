"""Session settings for tests and benches; on a cluster the caller brings the session."""

import os

from pyspark.sql import SparkSession


def local_session(cores: str | int = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the operators assume (UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("framelake")
        .config("spark.driver.memory", os.environ.get("FRAMELAKE_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
