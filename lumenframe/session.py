"""Session factory."""

from pyspark.sql import SparkSession


def get_spark(app: str = "lumenframe", master: str | None = None, **conf) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow on; ``conf`` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings | conf).getOrCreate()
