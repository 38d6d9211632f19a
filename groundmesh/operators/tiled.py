"""Filters over the neighbourhood of cells, tile by tile with the cells around it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, exact_scale

TILE = 128


def gauss(sigma: float, truncate: float = 4.0) -> np.ndarray:
    reach = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return w / w.sum()


def _beyond(at: np.ndarray, n: int, edges: str) -> np.ndarray:
    """Where the places ``at`` of an axis of n cells take their value: the nearest cell, or mirrored at the outer side of
    the border cells, again and again."""
    if edges == "nearest":
        return np.clip(at, 0, n - 1)
    at = np.mod(at, 2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def smooth(px: DataFrame, value: str, weights: np.ndarray, rows: int, cols: int, edges: str = "reflect", fill: float | None = None, tile: int = TILE) -> DataFrame:
    """row, col, value and smooth, the weighted mean along both axes, of the cells of a rows x cols grid that have a value.

    Cells without one count as ``fill`` (unset: the median); beyond the grid it goes on as ``edges`` says. A cell goes to the
    tiles that lie within the reach of the weights, and each tile is filtered on its own. Repeated cells take the last.
    """
    reach = len(weights) // 2
    v = px.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select("row", "col", F.col(value).cast("double").alias(value))
    if fill is None:
        (fill,) = exact_quantiles(v, value, [0.5])
        fill = fill if fill is not None else 0.0

    def to_tiles(c):
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)))

    def run(key, pdf):
        i, j = int(key[0]) * tile, int(key[1]) * tile
        at = np.full((min(tile, rows - i) + 2 * reach, min(tile, cols - j) + 2 * reach), fill)
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        inside = (r - i + reach < at.shape[0]) & (c - j + reach < at.shape[1])
        at[r[inside] - i + reach, c[inside] - j + reach] = pdf[value].to_numpy()[inside]
        across, down = _beyond(np.arange(at.shape[0]) + i - reach, rows, edges) - i + reach, _beyond(np.arange(at.shape[1]) + j - reach, cols, edges) - j + reach
        at = at[across][:, down]
        h, w = at.shape[0] - 2 * reach, at.shape[1] - 2 * reach
        at = sum(x * at[k : k + h] for k, x in enumerate(weights))
        at = sum(x * at[:, k : k + w] for k, x in enumerate(weights))
        own = pdf[(r >= i) & (r < i + h) & (c >= j) & (c < j + w)]
        return own[["row", "col", value]].assign(smooth=at[own["row"].to_numpy() - i, own["col"].to_numpy() - j])

    spread = v.withColumn("_i", to_tiles("row")).withColumn("_j", to_tiles("col"))
    spread = spread.where(f"_i >= 0 and _j >= 0 and _i * {tile} < {rows} and _j * {tile} < {cols}")
    kinds = dict(v.dtypes)
    return spread.groupBy("_i", "_j").applyInPandas(run, f"row {kinds['row']}, col {kinds['col']}, `{value}` double, smooth double")


def highpass(px: DataFrame, value: str, weights: np.ndarray, rows: int, cols: int, edges: str, tile: int = TILE) -> DataFrame:
    """n and sigma: the robust scale of a layer less its smooth form, over the cells that have a value."""
    d = smooth(px, value, weights, rows, cols, edges, tile=tile).select((F.col(value) - F.col("smooth")).alias("d"))
    return px.sparkSession.createDataFrame([(d.count(), exact_scale(d, "d")[1])], "n long, sigma double")


def highpass_box(px: DataFrame, col: str, rows: int, cols: int, tile: int = TILE) -> DataFrame:
    """Less the 3 x 3 mean; gaps take the median, borders repeat the nearest cell."""
    return highpass(px, col, np.full(3, 1 / 3), rows, cols, "nearest", tile)


def highpass_gauss(px: DataFrame, value: str, rows: int, cols: int, sigma: float = 3.0, tile: int = TILE) -> DataFrame:
    """Less the Gaussian mean, cut at 4 sigma; gaps take the median, borders are mirrored."""
    return highpass(px, value, gauss(sigma), rows, cols, "reflect", tile)
