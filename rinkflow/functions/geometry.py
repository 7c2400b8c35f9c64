"""Shot geometry on a rink whose attacked net stands at x = 89, y = 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distance of a net from the centre line, in feet, and bounds of the rink.
NET_X = 89
X_LIMIT = 100.0
Y_LIMIT = 42.5


def same_sign(a: Column, b: Column) -> Column:
    return F.signum(a) == F.signum(b)


def mirror(value: Column, net: Column) -> Column:
    """A coordinate seen from the attacking side."""
    return F.when(net == NET_X, value).otherwise(-value)


def net_distance(x: Column, y: Column) -> Column:
    dx = F.lit(float(NET_X)) - x
    return F.sqrt(dx * dx + y * y)


def net_angle(x: Column, y: Column, net: Column | None = None, compat: str = "fixed") -> Column:
    """Signed degrees from the net's axis, 0 at the net itself.

    With ``compat="reference"`` a mirrored shot from the axis behind the net is -180 instead of +180.
    """
    dx = F.lit(float(NET_X)) - x
    angle = F.degrees(F.atan2(y, dx))
    if compat == "reference" and net is not None:
        angle = F.when((net != NET_X) & (y == 0) & (dx < 0), F.lit(-180.0)).otherwise(angle)
    return F.when(net_distance(x, y) > 0, angle).otherwise(F.lit(0.0))


def delta_angle(a: Column, b: Column) -> Column:
    """Absolute difference of two angles, not wrapped at 360; 0 when one is missing."""
    return F.coalesce(F.abs(a - b), F.lit(0.0))


def travel(x: Column, y: Column, px: Column, py: Column) -> Column:
    return F.sqrt((x - px) * (x - px) + (y - py) * (y - py))


def puck_speed(distance: Column, seconds: Column) -> Column:
    """Distance per second, 0 when no time has passed or the distance is unknown."""
    return F.coalesce(F.when(seconds > 0, distance / seconds), F.lit(0.0))


def royal_road(seconds: Column, y: Column, prev_y: Column, prev_x: Column, net: Column) -> Column:
    """1 when play crossed the axis within 3 seconds from a place in the attacked half."""
    crossed = F.coalesce(F.signum(y) != F.signum(prev_y), F.lit(True))
    return F.coalesce((seconds <= 3) & crossed & same_sign(prev_x, net), F.lit(False)).cast("int")


def movement_demand(delta: Column, seconds: Column) -> Column:
    return delta / (seconds + 0.1)
