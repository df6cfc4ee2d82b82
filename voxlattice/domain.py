"""Scalar domains of the voxel grid and their checks.

Zoom z halves a cell along each axis. Altitude f is signed (2**z cells above ground, 2**z below), x and y are Web
Mercator indices, x is cyclic. Time is in seconds since the Unix epoch, in half-open spans below 2**35.
"""

from __future__ import annotations

from voxlattice.errors import IdError

#: Fixed values.
MAX_ZOOM = 30
MAX_TIME_ZOOM = 35
WHOLE = 1 << MAX_TIME_ZOOM
DAY, HOUR, MINUTE, SECOND = 86_400, 3_600, 60, 1
CALENDAR = (WHOLE, DAY, HOUR, MINUTE, SECOND)
MAX_LATITUDE = 85.0511
MAX_ALTITUDE = 33_554_432.0
#: WGS 84.
EARTH_A = 6_378_137.0
EARTH_F = 1.0 / 298.257223563
EARTH_B = EARTH_A * (1.0 - EARTH_F)
EARTH_E2 = 1.0 - (EARTH_B * EARTH_B) / (EARTH_A * EARTH_A)


def check_zoom(z: int) -> int:
    if not 0 <= z <= MAX_ZOOM:
        raise IdError(f"zoom {z} is not in 0..{MAX_ZOOM}")
    return z


def f_limits(z: int) -> tuple[int, int]:
    return -(1 << check_zoom(z)), (1 << z) - 1


def xy_limits(z: int) -> tuple[int, int]:
    return 0, (1 << check_zoom(z)) - 1


def limits(axis: str, z: int) -> tuple[int, int]:
    return f_limits(z) if axis == "f" else xy_limits(z)


def check_index(axis: str, z: int, index: int) -> int:
    low, high = limits(axis, z)
    if not low <= index <= high:
        raise IdError(f"{axis} index {index} is not in {low}..{high} at zoom {z}")
    return index


def check_span(interval: int, t: int) -> tuple[int, int]:
    """Seconds of the t-th interval."""
    if not 1 <= interval <= WHOLE:
        raise IdError(f"interval {interval} is not in 1..{WHOLE}")
    if t < 0 or (t + 1) * interval > WHOLE:
        raise IdError(f"time index {t} is out of range for interval {interval}")
    return t * interval, (t + 1) * interval
