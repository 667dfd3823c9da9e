"""Known logs and their true change points, by the corpora's naming rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions import scalars


def with_ground_truth(paths: DataFrame) -> DataFrame:
    """path -> path, log_source, log, actual; logs of one corpus with another number than 1000 cases are left out."""
    data = paths.select("path", scalars.log_source(F.col("path")).alias("log_source"), scalars.log_name(F.col("path")).alias("log"))
    cases = F.expr("try_cast(try_element_at(split(log, '_'), 4) as int)")
    points = (
        F.when(F.col("log_source") == "Bose", F.array(*(F.lit(float(x)) for x in (1199, 2399, 3599, 4799))))
        .when(F.col("log_source") == "Ostovar", F.array(F.lit(999.0), F.lit(1999.0)))
        .when((F.col("log_source") == "Ceravolo") & (cases == 1000), F.array((F.floor(cases / 2) - 1).cast("double")))
    )
    return data.withColumn("actual", points).where("actual is not null")
