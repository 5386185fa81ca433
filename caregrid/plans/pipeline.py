"""End-to-end plans over the driver tables: national registry -> Bronze -> heuristic Gold -> deserts.

Each stage is a ``DataFrame -> DataFrame`` function, so the whole chain is one
logical plan that Catalyst prunes and pushes down; callers materialise stages
(Parquet tables in the shared folder) where they want restartable boundaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caregrid.config import DEFAULT, Params
from caregrid.operators.bronze import ingest
from caregrid.operators.deserts import deserts
from caregrid.operators.gold import heuristic_gold
from caregrid.sources.national import load_national
from caregrid.sources.testdata import national_raw

CARRIED = ("category", "functional_status", "accessibility_note", "src_key")

_STAGES: dict = {}


def _memo(name: str):
    """Reuse a stage's DataFrame (the plan, not data) per session and input folder,
    so queries sharing a stage do not rebuild its expression trees on the driver."""

    def deco(fn):
        def wrapper(spark: SparkSession, sf_dir: str, *args):
            key = (name, id(spark), spark.sparkContext.applicationId, sf_dir, args)
            if key not in _STAGES:
                _STAGES[key] = fn(spark, sf_dir, *args)
            return _STAGES[key]

        wrapper.__name__ = fn.__name__
        wrapper.__doc__ = fn.__doc__
        return wrapper

    return deco


@_memo("registry")
def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National loader output (the facilities file handed to ingest)."""
    return load_national(national_raw(spark, sf_dir))


def bronze_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest(registry(spark, sf_dir), order_col="src_ord", carry=CARRIED)


@_memo("bronze")
def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze written once per session (Parquet, shared folder) and read back; see ``gold``."""
    from caregrid.sources.files import write_table

    path = table_path(spark, sf_dir, "bronze")
    write_table(bronze_plan(spark, sf_dir), path, mode="overwrite")
    return spark.read.parquet(path)


def gold_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heuristic Gold as one unmaterialised plan (raw rows -> Gold)."""
    return heuristic_gold(bronze(spark, sf_dir))


def table_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Location of a materialised stage: under the shared ``spark.checkpoint.dir``,
    one folder per application so concurrent runs never overwrite each other."""
    import hashlib

    from caregrid.session import ensure_checkpoint_dir

    root = ensure_checkpoint_dir(spark).rstrip("/")
    tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:10]
    return f"{root}/caregrid-tables/{spark.sparkContext.applicationId}/{tag}/{name}"


@_memo("gold")
def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold written once per session as Parquet in the shared folder and read back.

    Writing the table is the medallion boundary of the pipeline: downstream read
    models (deserts, ranking, search) start from a shallow scan instead of
    re-planning the wide rule expressions, and a lost executor re-reads the
    table instead of recomputing the whole lineage.
    """
    from caregrid.sources.files import write_table

    path = table_path(spark, sf_dir, "gold")
    write_table(gold_plan(spark, sf_dir), path, mode="overwrite")
    return spark.read.parquet(path)


@_memo("deserts")
def desert_table(spark: SparkSession, sf_dir: str, params: Params = DEFAULT) -> DataFrame:
    return deserts(gold(spark, sf_dir), params)
