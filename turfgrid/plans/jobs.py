"""Whole jobs: files to located passes, training, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfgrid.constants import CHANNELS, CUTOFF, EPOCHS, Pitch
from turfgrid.operators import raster
from turfgrid.operators.fit import SurfaceModel, destination_features, fit_selection, fit_success, with_means
from turfgrid.operators.metrics import class_report, metrics
from turfgrid.operators.selection import COUNTED, SET, aimed_totals, with_log_total
from turfgrid.operators.slots import locate, with_carrier
from turfgrid.operators.splits import split
from turfgrid.operators.surfaces import classify
from turfgrid.operators.validate import accepted, drop_unlabelled, require_valid
from turfgrid.functions.cells import sigmoid


def prepare(passes: DataFrame, pitch: Pitch = Pitch(), compat: bool = False, strict: bool = False) -> DataFrame:
    """Usable passes with label, cells, roles and carrier: the input of all channels."""
    labelled = require_valid(passes) if strict else drop_unlabelled(passes)
    return locate(accepted(with_carrier(labelled, compat)), pitch, compat)


def train_success(passes: DataFrame, epochs: int = EPOCHS) -> SurfaceModel:
    return fit_success(prepare(split(passes).where(F.col("split") == "train")), epochs)


def train_selection(passes: DataFrame, epochs: int = EPOCHS) -> SurfaceModel:
    return fit_selection(prepare(split(passes)), epochs)


def predict_destination(located: DataFrame, model: SurfaceModel, pitch: Pitch = Pitch()) -> DataFrame:
    """`p` at each pass's destination.

    Success needs the destination's channels only. Selection needs the sum over the surface, which comes from
    sums by goal step; no cell is made.
    """
    truth = F.col("target") if model.head == "sigmoid" else F.lit(1)
    if len(model.coefficients) > len(CHANNELS):
        located = with_means(located, pitch)
    w = model.coefficients
    if model.head == "softmax" and len(w) == len(CHANNELS) and any(w[c - 1] for c in (*COUNTED, *SET)):
        total = aimed_totals(located, w, pitch)
        return total.select("pass_id", F.lit(1).alias("y_true"), F.exp(F.col("z_aim") - F.col("log_total")).alias("p"))
    aimed = destination_features(located, pitch, players=True)
    z_aim = model.logit()
    if model.head == "sigmoid":
        return aimed.select("pass_id", truth.alias("y_true"), sigmoid(z_aim).alias("p"))
    passes = aimed.withColumn("z_aim", z_aim - F.lit(float(model.intercept)))
    total = with_log_total(passes, model.coefficients, pitch)
    return total.select("pass_id", truth.alias("y_true"), F.exp(F.col("z_aim") - F.col("log_total")).alias("p"))


def evaluate(located: DataFrame, model: SurfaceModel, cutoff: float = CUTOFF, pitch: Pitch = Pitch()) -> DataFrame:
    """The one-row evaluation table of a model."""
    return metrics(classify(predict_destination(located, model, pitch), cutoff))


def report(located: DataFrame, model: SurfaceModel, cutoff: float = CUTOFF, pitch: Pitch = Pitch()) -> DataFrame:
    return class_report(classify(predict_destination(located, model, pitch), cutoff))


def network_on_tables(stack: DataFrame, weights: DataFrame, bias: DataFrame, pitch: Pitch) -> DataFrame:
    """The surface network as raster operators on long tables; logits (pass_id, y, x, value).

    For small pitches and single kernels, and as the check of `score_surfaces`. Lay `stack` out by
    pass first; the chain then runs without a further shuffle.
    """

    def layer(table, name, rows, cols, k):
        own = F.col("layer") == name
        return raster.focal_conv(table, weights.where(own), bias.where(own), rows, cols, k)

    def features(table, scale, rows, cols):
        for part in ("1", "2"):
            table = raster.relu(layer(table, f"features_{scale}.{part}", rows, cols, 5))
            table = raster.replicate_pad(table, rows - 4, cols - 4, 2)
        return table

    def prediction(table, scale, rows, cols):
        return layer(raster.relu(layer(table, f"prediction_{scale}.1", rows, cols, 1)), f"prediction_{scale}.2", rows, cols, 1)

    def enlarge(table, scale, rows, cols):
        table = raster.relu(layer(raster.upsample(table), f"up_{scale}.1", rows, cols, 3))
        table = layer(raster.replicate_pad(table, rows - 2, cols - 2, 1), f"up_{scale}.2", rows, cols, 3)
        return raster.replicate_pad(table, rows - 2, cols - 2, 1)

    def fused(coarse, fine, name, rows, cols):
        both = coarse.withColumn("ch", F.lit(0)).unionByName(fine.withColumn("ch", F.lit(1)))
        return layer(both, name, rows, cols, 1)

    h, w = pitch.rows, pitch.cols
    full = features(stack, "x1", h, w)
    half = features(raster.max_pool(full, h, w), "x2", h // 2, w // 2)
    quarter = features(raster.max_pool(half, h // 2, w // 2), "x4", h // 4, w // 4)
    coarse = fused(
        enlarge(prediction(quarter, "x4", h // 4, w // 4), "x4", h // 2, w // 2),
        prediction(half, "x2", h // 2, w // 2),
        "fusion_x2_x4",
        h // 2,
        w // 2,
    )
    fine = fused(enlarge(coarse, "x2", h, w), prediction(full, "x1", h, w), "fusion_x1_x2", h, w)
    return fine.select("pass_id", "y", "x", "value")
