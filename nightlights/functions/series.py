"""NumPy kernels over whole series: reflection, Gaussian filters, iterative clipping."""

from __future__ import annotations

import numpy as np


def reflected(index: np.ndarray, n: int) -> np.ndarray:
    """Places of a series of n that mirror, edge sample twice, without end; n may be shorter than the kernel."""
    m = np.mod(index, 2 * n)
    return np.where(m < n, m, 2 * n - 1 - m)


def gaussian_kernel(sigma: float) -> np.ndarray:
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter along the first axis with reflected edges."""
    w = gaussian_kernel(sigma)
    radius = len(w) // 2
    padded = x[reflected(np.arange(-radius, len(x) + radius), len(x))]
    if x.ndim == 1:
        return np.convolve(padded, w, "valid")
    return np.stack([np.convolve(padded[:, k], w, "valid") for k in range(x.shape[1])], 1)


def clip_stats(x: np.ndarray, k: float = 2.0, rounds: int = 10, usable: np.ndarray | None = None) -> tuple[float, float]:
    """Mean and deviation of what is left of x, or of its usable part, after dropping, again and again, what is over k deviations from the mean."""
    keep = np.ones(len(x), bool) if usable is None else usable.copy()
    for _ in range(rounds):
        left = x[keep]
        keep &= np.abs(x - left.mean()) <= k * left.std()
    return float(x[keep].mean()), float(x[keep].std())


def clipped(x: np.ndarray, k: float = 3.0, rounds: int = 10, centre: str = "median", upper_only: bool = False) -> np.ndarray:
    """Which samples stay after clipping around the mean or median."""
    keep = np.ones(len(x), bool)
    for _ in range(rounds):
        left = x[keep]
        mid, sd = (np.median(left) if centre == "median" else left.mean()), left.std()
        keep &= (x - mid <= k * sd) & (upper_only | (mid - x <= k * sd))
    return keep
