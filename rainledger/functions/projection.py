"""Longitude and latitude to the Dutch metric grid and back by the published polynomial (better than a metre inland)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Origin and coefficients (p, q, value) of the polynomial.
_LAT0, _LON0, _X0, _Y0 = 52.15517440, 5.38720621, 155000.0, 463000.0
_X = [(0, 1, 190094.945), (1, 1, -11832.228), (2, 1, -114.221), (0, 3, -32.391), (1, 0, -0.705), (3, 1, -2.340), (1, 3, -0.608), (0, 2, -0.008), (2, 3, 0.148)]
_Y = [(1, 0, 309056.544), (0, 2, 3638.893), (2, 0, 73.077), (1, 2, -157.984), (3, 0, 59.788), (0, 1, 0.433), (2, 2, -6.439), (1, 1, -0.032), (0, 4, 0.092), (1, 4, -0.054)]


def metric_grid(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in metres."""
    a, b = 0.36 * (lat - _LAT0), 0.36 * (lon - _LON0)
    term = lambda p, q, v: v * F.pow(a, F.lit(p)) * F.pow(b, F.lit(q))
    return sum((term(*t) for t in _X), F.lit(_X0)), sum((term(*t) for t in _Y), F.lit(_Y0))


# Coefficients (p, q, value) of the inverse polynomials, in seconds of arc per 100 km.
_LAT = [(0, 1, 3235.65389), (2, 0, -32.58297), (0, 2, -0.24750), (2, 1, -0.84978), (0, 3, -0.06550), (2, 2, -0.01709), (1, 0, -0.00738), (4, 0, 0.00530), (2, 3, -0.00039), (4, 1, 0.00033), (1, 1, -0.00012)]
_LON = [(1, 0, 5260.52916), (1, 1, 105.94684), (1, 2, 2.45656), (3, 0, -0.81885), (1, 3, 0.05594), (3, 1, -0.05607), (0, 1, 0.01199), (3, 2, -0.00256), (1, 4, 0.00128), (0, 2, 0.00022), (2, 0, -0.00022), (5, 0, 0.00026)]


def degrees_of_grid(x: Column, y: Column) -> tuple[Column, Column]:
    """(latitude, longitude) of a place on the metric grid."""
    a, b = (x - _X0) * 1e-5, (y - _Y0) * 1e-5
    term = lambda p, q, v: v * F.pow(a, F.lit(p)) * F.pow(b, F.lit(q))
    return F.lit(_LAT0) + sum((term(*t) for t in _LAT), F.lit(0.0)) / 3600, F.lit(_LON0) + sum((term(*t) for t in _LON), F.lit(0.0)) / 3600
