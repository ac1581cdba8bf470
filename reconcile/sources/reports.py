"""Run reports, outcomes and traces as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from reconcile.schemas import PLAN_OBJECT, REPORTS
from reconcile.sources.plan_json import write_plans

_BAD = "_corrupt_record"


def read_reports(
    spark: SparkSession, path: str, kind: str, strict: bool = True, multi_line: bool = True
) -> DataFrame:
    """Report documents of one ``kind``.

    ``strict`` fails on a document of the wrong shape.  Otherwise its text is
    kept in ``_corrupt_record`` and the other columns are what could be read.
    """
    schema, _ = REPORTS[kind]
    reader = spark.read.option("multiLine", multi_line)
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    # The nested fields are typed as objects, so text or a list there is corrupt.
    return (
        reader.schema(T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())]))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD)
        .json(path)
    )


def shape_errors(texts: DataFrame, kind: str) -> DataFrame:
    """Rows of raw ``value`` text that are no report of ``kind``."""
    _, objects = REPORTS[kind]
    doc = F.try_parse_json("value")
    top = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))

    def nested(field: str):
        part = F.schema_of_variant(F.try_variant_get(doc, f"$.{field}", "variant"))
        return F.when(
            part.isNotNull() & ~part.startswith("OBJECT"),
            F.lit(f"report field `{field}` must be an object"),
        )

    reason = F.when(~top, F.lit("report JSON must be an object")).otherwise(
        F.coalesce(*[nested(f) for f in objects])
    )
    return texts.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def write_reports(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_run_report(
    spark: SparkSession,
    path: str,
    command: str,
    exit_code: int,
    plan: DataFrame | None = None,
) -> None:
    """Outcome of a run, with its plan beside it.

    A run without a plan replaces the earlier plan by an empty one, so nobody
    reads a stale plan next to a failure.
    """
    if plan is not None:
        write_plans(plan, f"{path}/plan", command)
    else:
        for part in ("objects", "header", "blockers", "schemas"):
            spark.createDataFrame([], PLAN_OBJECT).write.mode("overwrite").json(
                f"{path}/plan/{part}"
            )
    row = [(command, "success" if exit_code == 0 else "failure", exit_code)]
    spark.createDataFrame(row, "command string, result string, exitCode int").write.mode(
        "overwrite"
    ).json(f"{path}/report")


def append_traces(df: DataFrame, path: str) -> None:
    """One record per plan phase run; the log only grows."""
    df.write.mode("append").json(path)


def read_traces(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
