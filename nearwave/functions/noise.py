"""Noise between 0 and 1: a standard normal conditioned on that interval.

Drawn by inverting the normal distribution function on the matching slice of
probabilities, so one uniform number is enough and nothing is re-drawn.
"""

from __future__ import annotations

import numpy as np

# Central branch of P. Acklam's published rational approximation of
# the inverse normal distribution function, and the probability mass of [0, 1].
INVERSE_NORMAL_NUMERATOR = (
    -3.969683028665376e01,
    2.209460984245205e02,
    -2.759285104469687e02,
    1.383577518672690e02,
    -3.066479806614716e01,
    2.506628277459239e00,
)
INVERSE_NORMAL_DENOMINATOR = (
    -5.447609879822406e01,
    1.615858368580409e02,
    -1.556989798598866e02,
    6.680131188771972e01,
    -1.328068155288572e01,
)
MASS_ZERO_TO_ONE = 0.3413447460685429


def unit_normal(u: np.ndarray) -> np.ndarray:
    """Map uniforms in (0, 1) to normals restricted to [0, 1]."""
    q = u * MASS_ZERO_TO_ONE
    r = q * q
    a, b = INVERSE_NORMAL_NUMERATOR, INVERSE_NORMAL_DENOMINATOR
    num = ((((a[0] * r + a[1]) * r + a[2]) * r + a[3]) * r + a[4]) * r + a[5]
    den = ((((b[0] * r + b[1]) * r + b[2]) * r + b[3]) * r + b[4]) * r + 1.0
    return np.minimum(num * q / den, 1.0)
