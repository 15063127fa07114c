"""Zone dimension work: trip labels, origin-destination lookups and flag shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareframe.functions import places
from fareframe.operators.joins import flag_membership, join_zone_roles, non_conflicting


def add_trip_flags(
    df: DataFrame,
    null_as: bool | None = False,
    airports: Sequence[int] | None = places.AIRPORT_ZONES,
    borough: str = places.CENTRE_BOROUGH,
) -> DataFrame:
    """Cross-borough, centre-borough and airport involvement from the joined zone columns.

    ``null_as`` is the answer where a borough is missing. ``airports=None`` decides by the
    service zone instead of by zone id.
    """
    pu, do = F.col("PU_Borough"), F.col("DO_Borough")
    if airports is None:
        airport = places.involves_airport_service(F.col("PU_service_zone"), F.col("DO_service_zone"))
    else:
        airport = places.involves_airport_ids(F.col("PULocationID"), F.col("DOLocationID"), airports)
    return df.withColumns(
        {
            "is_cross_borough": places.cross_borough(pu, do, null_as),
            "involves_manhattan": places.involves_borough(pu, do, borough, null_as),
            "involves_airport": airport,
        }
    )


def add_cbd_flags(df: DataFrame, cbd: DataFrame | None) -> DataFrame:
    """``PU_in_cbd``, ``DO_in_cbd`` and ``trip_cbd_type``. ``cbd`` lists the CBD zones' ``LocationID``."""
    if cbd is None:
        zero = F.lit(0)
        return df.withColumns({"PU_in_cbd": zero, "DO_in_cbd": zero, "trip_cbd_type": places.cbd_type(None, None)})
    df = flag_membership(df, "PULocationID", cbd, "LocationID", "PU_in_cbd")
    df = flag_membership(df, "DOLocationID", cbd, "LocationID", "DO_in_cbd")
    return df.withColumn("trip_cbd_type", places.cbd_type(F.col("PU_in_cbd"), F.col("DO_in_cbd")))


def label_trips(df: DataFrame, dim: DataFrame, cbd: DataFrame | None, **flags) -> DataFrame:
    """Zone names for both ends, CBD type and involvement flags."""
    return df.transform(join_zone_roles, dim).transform(add_cbd_flags, cbd).transform(add_trip_flags, **flags)


def od_pairs(dim: DataFrame, key: str = "LocationID") -> DataFrame:
    """All ordered zone pairs.

    The product is the feature here; its size is the square of the zone dimension, never of the trips.
    The id list reaches the rows as one scalar array.
    """
    ids = dim.where(F.col(key).isNotNull()).select(key).distinct()
    every = ids.agg(F.sort_array(F.collect_list(key)).alias("ids")).scalar()
    return ids.select(F.col(key).alias("PULocationID"), F.explode(every).alias("DOLocationID"))


def build_od_features(dim: DataFrame, cbd: DataFrame | None, **flags) -> DataFrame:
    """The origin-destination lookup: every zone pair with its 12 spatial features, stored once."""
    return label_trips(od_pairs(dim), dim, cbd, **flags)


def zones_with_flags(zones: DataFrame, lookup: DataFrame, cbd: DataFrame, key: str = "LocationID") -> DataFrame:
    """Zones with lookup names and ``in_cbd``, 0 where the mapping has no row."""
    named = zones.join(non_conflicting(zones, lookup, [key]), key, "left")
    return (
        named.drop("in_cbd")
        .join(cbd.select(key, F.col("in_cbd").cast("int").alias("in_cbd")), key, "left")
        .withColumn("in_cbd", F.coalesce("in_cbd", F.lit(0)))
    )


def flag_count_by_group(dim: DataFrame, members: DataFrame, key: str, group: str) -> DataFrame:
    """Members per group of the dimension, largest first."""
    joined = dim.join(members.select(key), key)
    return joined.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group)


def flag_share_by_group(df: DataFrame, group: str, flag: str) -> DataFrame:
    """Rows, flagged rows and flagged percentage (1 decimal) per group."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(flag).cast("bigint").alias("flagged"),
        F.round(F.sum(flag) / F.count(F.lit(1)) * 100, 1).alias("pct"),
    )
