"""Peaks of a spectrum with their widths at half prominence, one group a spectrum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship_code


def find_peaks(y: np.ndarray, height: float) -> np.ndarray:
    """Local maxima of at least `height`; a plateau counts at its middle."""
    out, i = [], 1
    while i < len(y) - 1:
        if y[i] > y[i - 1]:
            j = i
            while j + 1 < len(y) and y[j + 1] == y[i]:
                j += 1
            if j + 1 < len(y) and y[j + 1] < y[i] and y[i] >= height:
                out.append((i + j) // 2)
            i = j
        i += 1
    return np.array(out, int)


def prominence(y: np.ndarray, p: int) -> float:
    left, right = p, p
    while left > 0 and y[left - 1] <= y[p]:
        left -= 1
    while right < len(y) - 1 and y[right + 1] <= y[p]:
        right += 1
    return float(y[p] - max(y[left : p + 1].min(), y[p : right + 1].min()))


def half_width(x: np.ndarray, y: np.ndarray, p: int) -> float:
    """Width at half the prominence, interpolated between samples."""
    level = y[p] - prominence(y, p) / 2
    i = p
    while i > 0 and y[i] > level:
        i -= 1
    a = x[i] if y[i] == level or y[i] > level else x[i] + (level - y[i]) / (y[i + 1] - y[i]) * (x[i + 1] - x[i])
    j = p
    while j < len(y) - 1 and y[j] > level:
        j += 1
    b = x[j] if y[j] == level or y[j] > level else x[j] - (level - y[j]) / (y[j - 1] - y[j]) * (x[j] - x[j - 1])
    return float(b - a)


def peak_table(spectrum: DataFrame, low: float, high: float, rel_height: float = 0.1, max_peaks: int = 20) -> DataFrame:
    """label, f, y, width: the strongest max_peaks peaks of each spectrum, by frequency."""
    ship_code(spectrum.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("f")
        x, y = pdf["f"].to_numpy(), pdf["y"].to_numpy()
        found = find_peaks(y, rel_height * y.max()) if len(y) else np.zeros(0, int)
        found = np.sort(found[np.argsort(-y[found], kind="stable")[:max_peaks]])
        return pd.DataFrame({"label": pdf["label"].iloc[0], "f": x[found], "y": y[found], "width": [half_width(x, y, p) for p in found]}, columns=["label", "f", "y", "width"])

    kind = dict(spectrum.dtypes)["label"]
    return spectrum.filter(f"f between {low} and {high}").groupBy("label").applyInPandas(one, f"label {kind}, f double, y double, width double")
