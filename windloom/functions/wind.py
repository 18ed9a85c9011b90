"""Wind and power expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed physical values: sea-level density (kg/m3), gas constant of dry air, Betz limit.
AIR_DENSITY, GAS_CONSTANT, BETZ = 1.225, 287.05, 16 / 27

#: Share of a limit by which doubles may miss it through rounding alone: a value this near to the limit is at the limit.
TIE = 1e-12


def air_density(temperature_c: Column, pressure_hpa: Column) -> Column:
    return pressure_hpa * 100 / (GAS_CONSTANT * (temperature_c + 273.15))


def available_power_kw(speed: Column, rotor_diameter_m: float, density: Column | float = AIR_DENSITY) -> Column:
    area = 3.141592653589793 * (rotor_diameter_m / 2) ** 2
    density = density if isinstance(density, Column) else F.lit(density)
    return 0.5 * density * area * F.pow(speed, F.lit(3.0)) / 1000


def power_coefficient(power_kw: Column, speed: Column, rotor_diameter_m: float, density: Column | float = AIR_DENSITY, least_speed: float = 3.0) -> Column:
    """Share of the wind's power; NULL in winds below ``least_speed``."""
    return F.when(speed >= least_speed, F.try_divide(power_kw, available_power_kw(speed, rotor_diameter_m, density)))


def curve_bin(speed: Column) -> Column:
    """Centre of the power-curve bin: right-closed bins of 0.5 to 20 m/s and of 2 to 28 m/s, 0 in the first; else NULL."""
    return (
        F.when(speed == 0, 0.25)
        .when((speed > 0) & (speed <= 20), F.ceil(speed / 0.5) * 0.5 - 0.25)
        .when((speed > 20) & (speed <= 28), 20 + F.ceil((speed - 20) / 2) * 2.0 - 1)
        .cast("double")
    )


def right_closed_bin(value: Column, low: float, width: float) -> Column:
    """Number of the bin (low + k width, low + (k + 1) width]."""
    return (F.ceil((value - low) / width) - 1).cast("int")


def clip_low(value: Column, low: float = 0.0) -> Column:
    """At least ``low``; NULL stays NULL (greatest would skip it)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def reanalysis_miss(speed: Column, output: Column, capacity: float) -> Column:
    """Rows in which the reanalysis shows a calm but the farm makes more than half its capacity."""
    return F.coalesce((speed < 2.0) & (output > 0.5 * capacity), F.lit(False))


def yaw_status(mean_deg: Column, ci_low: Column, ci_high: Column, spread_deg: Column, flag_at: float = 3.0, widest: float = 10.0) -> Column:
    """``inconclusive`` if a value is missing or the estimates by wind speed spread too far; ``flag`` if the offset is
    material and its confidence interval excludes zero; else ``ok``.  Values at a limit count as the limit in any order of summing."""
    known = mean_deg.isNotNull() & ci_low.isNotNull() & ci_high.isNotNull() & spread_deg.isNotNull()
    return (
        F.when(~known | (spread_deg > widest * (1 + TIE)), "inconclusive")
        .when((F.abs(mean_deg) >= flag_at * (1 - TIE)) & ((ci_low > 0) | (ci_high < 0)), "flag")
        .otherwise("ok")
    )


def day_ahead_price(ts: Column) -> Column:
    """A stand-in price (EUR/MWh) by the row's own hour: dearer from 7 to 21."""
    return F.when(F.hour(ts).between(7, 21), 80.0).otherwise(55.0)
