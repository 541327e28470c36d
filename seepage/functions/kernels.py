"""Distance kernels and self-confidence penalties, as column expressions by name."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kernel weights w(distance, scale). Add entries to use kernels of your own.
KERNELS: dict[str, Callable[[Column, Column], Column]] = {
    "exponential": lambda d, scale: F.exp(-d / scale),
    "gaussian": lambda d, scale: F.exp(-(d * d) / (2 * scale * scale)),
    "inverse": lambda d, scale: 1 / (d + 1e-6),
}

#: The same on arrays, for matrix products; a kernel without an entry is only used by rows.
ARRAY_KERNELS: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {
    "exponential": lambda d, scale: np.exp(-d / scale),
    "gaussian": lambda d, scale: np.exp(-(d * d) / (2 * scale * scale)),
    "inverse": lambda d, scale: 1 / (d + 1e-6),
}

#: Penalties f(rate, p50 and p90 of the gene's positive rates).
PENALTIES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "linear_p90": lambda s, p50, p90: 1 / (1 + s / p90),
    "linear_p50": lambda s, p50, p90: 1 / (1 + s / p50),
    "quadratic_p90": lambda s, p50, p90: 1 / (1 + (s / p90) * (s / p90)),
    "exponential_p90": lambda s, p50, p90: F.exp(-s / p90),
    "inverse_p50": lambda s, p50, p90: F.when(s <= p50, F.lit(1.0)).otherwise(p50 / s),
}


def kernel(name: str) -> Callable[[Column, Column], Column]:
    if name not in KERNELS:
        raise ValueError(f"unknown kernel {name!r}; known: {sorted(KERNELS)}")
    return KERNELS[name]


def penalty(name: str) -> Callable[[Column, Column, Column], Column]:
    """An unknown name means the linear p90 form."""
    return PENALTIES.get(name, PENALTIES["linear_p90"])
