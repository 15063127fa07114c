"""Origin-destination labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone ids of the three airports and the centre borough.
AIRPORT_ZONES = (1, 132, 138)
AIRPORT_SERVICE_ZONE = "Airports"
CENTRE_BOROUGH = "Manhattan"


def cbd_type(pu_in_cbd: Column | None, do_in_cbd: Column | None) -> Column:
    """intra / outbound / inbound / non_cbd from two 0/1 flags; ``unknown`` without a CBD dimension."""
    if pu_in_cbd is None or do_in_cbd is None:
        return F.lit("unknown")
    return (
        F.when((pu_in_cbd == 1) & (do_in_cbd == 1), "intra_cbd")
        .when((pu_in_cbd == 1) & (do_in_cbd == 0), "outbound_cbd")
        .when((pu_in_cbd == 0) & (do_in_cbd == 1), "inbound_cbd")
        .otherwise("non_cbd")
    )


def cross_borough(pu: Column, do: Column, null_as: bool | None = False) -> Column:
    """Boolean; a missing borough gives ``null_as``."""
    return F.when(pu.isNotNull() & do.isNotNull(), pu != do).otherwise(F.lit(null_as).cast("boolean"))


def involves_borough(pu: Column, do: Column, borough: str = CENTRE_BOROUGH, null_as: bool | None = False) -> Column:
    """Either end in ``borough``. ``null_as=None`` keeps SQL three-valued logic (false OR null is null)."""
    either = (pu == borough) | (do == borough)
    return either if null_as is None else F.coalesce(either, F.lit(null_as))


def involves_airport_ids(pu: Column, do: Column, airports: Sequence[int] = AIRPORT_ZONES) -> Column:
    return pu.isin(*airports) | do.isin(*airports)


def involves_airport_service(pu_service: Column, do_service: Column, label: str = AIRPORT_SERVICE_ZONE) -> Column:
    return F.coalesce((pu_service == label) | (do_service == label), F.lit(False))
