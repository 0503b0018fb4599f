"""Spectral features of an array column.  An FFT has no JVM counterpart, so Arrow batches carry it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

LOW_BAND = "power_low double, power_ratio double, peak_freq double, entropy double, slope double"


def _by_length(series: pd.Series):
    """Stacked float matrices of equally long rows, with their positions."""
    lengths = series.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.stack(series.iloc[at].to_numpy()).astype(np.float64)


def _power(x: np.ndarray) -> np.ndarray:
    spec = np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)
    return spec.real**2 + spec.imag**2


def low_band_features(ts: Column, tr: float = 1.8, low: float = 0.01, high: float = 0.10) -> Column:
    """Power, power share, peak, entropy and log-log slope of the band ``low`` to ``high`` Hz."""

    @F.pandas_udf(LOW_BAND)
    def compute(col: pd.Series) -> pd.DataFrame:
        out = np.full((len(col), 5), np.nan)
        for at, x in _by_length(col):
            freqs = np.fft.rfftfreq(x.shape[1], d=tr)
            band = (freqs >= low) & (freqs <= high)
            if not band.any():
                raise ValueError("no frequency of the series falls into the low band")
            power = _power(x)
            inside, f = power[:, band], freqs[band]
            share = inside + 1e-12
            share = share / share.sum(axis=1, keepdims=True)
            lf = np.log(f + 1e-12)
            lf = lf - lf.mean()
            lp = np.log(inside + 1e-12)
            out[at, 0] = inside.sum(axis=1)
            out[at, 1] = out[at, 0] / (power[:, 1:].sum(axis=1) + 1e-12)
            out[at, 2] = f[inside.argmax(axis=1)]
            out[at, 3] = -(share * np.log(share)).sum(axis=1) / np.log(float(len(f)))
            out[at, 4] = (lp - lp.mean(axis=1, keepdims=True)) @ lf / ((lf * lf).sum() + 1e-12)
        return pd.DataFrame(out, columns=["power_low", "power_ratio", "peak_freq", "entropy", "slope"])

    return compute(ts)


def low_power_ratio(ts: Column, tr: float = 1.8, cut: float = 0.10) -> Column:
    """Share of the power at 0 < f <= ``cut``."""

    @F.pandas_udf("double")
    def compute(col: pd.Series) -> pd.Series:
        out = np.zeros(len(col))
        for at, x in _by_length(col):
            freqs = np.fft.rfftfreq(x.shape[1], d=tr)
            power = _power(x)
            low = (freqs > 0) & (freqs <= cut)
            out[at] = power[:, low].sum(axis=1) / (power.sum(axis=1) + 1e-12)
        return pd.Series(out)

    return compute(ts)
