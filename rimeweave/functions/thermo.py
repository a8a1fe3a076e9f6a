"""Ice supersaturation (Si) from frost point, humidity or mixing ratio."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import finite, num


def es_ice(celsius: Column) -> Column:
    """Saturation vapour pressure over ice, Murphy and Koop form.

    NULL at or below absolute zero: ``ln`` of a non-positive number is NULL.
    Only ratios of this quantity are used, so its unit cancels.
    """
    k = celsius + num(273.15)
    return F.exp(
        num(9.550426) - F.try_divide(num(5723.265), k) + num(3.53068) * F.ln(k) - num(0.007283) * k
    )


def es_ice_tetens(celsius: Column) -> Column:
    """Saturation vapour pressure over ice in hPa, Tetens form."""
    return num(6.112) * F.exp(F.try_divide(num(22.46) * celsius, num(272.62) + celsius))


def si_from_frost_point(frost_c: Column, air_c: Column) -> Column:
    return finite(F.try_divide(es_ice(frost_c), es_ice(air_c)) - num(1))


def si_from_frost_point_tetens(frost_c: Column, air_c: Column) -> Column:
    return finite(F.try_divide(es_ice_tetens(frost_c), es_ice_tetens(air_c)) - num(1))


def si_from_ppmv(ppmv: Column, kelvin: Column, hpa: Column, bound_temperature: bool = True) -> Column:
    """Si from a water-vapour mixing ratio; NULL where an input is unphysical.

    ``bound_temperature`` additionally requires 150 K <= T <= 350 K.
    """
    usable = (ppmv > num(0)) & (hpa > num(0))
    if bound_temperature:
        usable = usable & kelvin.between(num(150), num(350))
    saturated = num(6.112) * F.exp(
        F.try_divide(num(22.46) * (kelvin - num(273.15)), kelvin - num(0.55))
    )
    actual = ppmv / num(1e6) * hpa
    return F.when(usable, finite(F.try_divide(actual, saturated) - num(1)))


def si_from_rh(rh_percent: Column) -> Column:
    """Si from relative humidity over ice in percent."""
    return finite(rh_percent / num(100) - num(1))
