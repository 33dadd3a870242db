"""Filters and checks on the pass table. All of them are narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfgrid.constants import OUTCOME_LABELS
from turfgrid.functions.cells import encode_outcome, missing


def drop_unlabelled(passes: DataFrame) -> DataFrame:
    """Passes that have an outcome code."""
    return passes.na.drop(subset=["pass_outcome_type"])


def unknown_outcome() -> Column:
    code = F.col("pass_outcome_type")
    return code.isNotNull() & encode_outcome(code).isNull()


def no_destination() -> Column:
    return missing(F.col("ball_x_end")) | missing(F.col("ball_y_end"))


def check_outcome(passes: DataFrame) -> DataFrame:
    """Passes whose code is not in the code table."""
    return passes.where(unknown_outcome())


def check_destination(passes: DataFrame) -> DataFrame:
    """Passes without a known end."""
    return passes.where(no_destination())


def with_reject_reason(passes: DataFrame) -> DataFrame:
    """Add `reject_reason`, NULL for a usable pass."""
    reason = (
        F.when(F.col("pass_outcome_type").isNull(), "no_outcome")
        .when(unknown_outcome(), "unknown_outcome")
        .when(no_destination(), "no_destination")
    )
    return passes.withColumn("reject_reason", reason)


def accepted(passes: DataFrame) -> DataFrame:
    """Passes with a known code and a known end, as one short predicate the scan can take."""
    return passes.where(F.col("pass_outcome_type").isin(list(OUTCOME_LABELS)) & ~no_destination())


def rejected(passes: DataFrame) -> DataFrame:
    return with_reject_reason(passes).where(F.col("reject_reason").isNotNull())


def require_valid(passes: DataFrame) -> DataFrame:
    """Strict form: passes without an outcome are dropped, any other defect fails the job."""
    message = F.when(unknown_outcome(), F.concat(F.lit("Invalid pass_outcome_type: "), "pass_outcome_type")).when(
        no_destination(), F.lit("End coordinates not known.")
    )
    checked = F.when(message.isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("pass_outcome_type"))
    return drop_unlabelled(passes).withColumn("pass_outcome_type", checked)


def resolvable(with_carrier: DataFrame) -> DataFrame:
    """Flag passes whose passer was found among the slots."""
    return with_carrier.withColumn("resolved", F.col("carrier_slot").isNotNull())
