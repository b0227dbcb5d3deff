"""The corpus pipeline: STAGES, ORACLE_SQL and run(spark, sf_dir). Part of the
training-data operators; the stages are in verbatim_spark.llm.pipeline."""

from verbatim_spark.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
