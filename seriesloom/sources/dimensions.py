"""Small dimension tables. All values are fixed: classifications and labels depend on them.

Larger dimensions (sites, countries) are read from the user's files with `readers.read_dimension`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Seismic regions as (name, lat_lo, lat_hi, lon_lo, lon_hi), first match wins, else "intraplate".
SEISMIC_REGIONS = [
    ("pacific_west", -60.0, 60.0, 100.0, 180.0),
    ("pacific_east", -60.0, 65.0, -180.0, -60.0),
    ("med_himalayan", 20.0, 50.0, -10.0, 100.0),
    ("mid_atlantic", -60.0, 80.0, -60.0, -10.0),
    ("east_african_rift", -35.0, 15.0, 25.0, 45.0),
]

# Ocean basins as (name, lat_lo, lat_hi, lon_lo, lon_hi); two boxes cross the date line.
OCEAN_BASINS = [
    ("Global Ocean", -89.5, 89.5, -179.5, 179.5),
    ("North Atlantic", 0.0, 60.0, -80.0, 0.0),
    ("South Atlantic", -60.0, 0.0, -70.0, 20.0),
    ("North Pacific", 0.0, 60.0, 100.0, 179.5),
    ("North Pacific", 0.0, 60.0, -179.5, -100.0),
    ("South Pacific", -60.0, 0.0, 150.0, 179.5),
    ("South Pacific", -60.0, 0.0, -179.5, -70.0),
    ("Indian Ocean", -60.0, 25.0, 20.0, 120.0),
    ("Southern Ocean", -90.0, -60.0, -179.5, 179.5),
    ("Arctic Ocean", 60.0, 90.0, -179.5, 179.5),
    ("Tropical Band", -20.0, 20.0, -179.5, 179.5),
]

# Currencies with region and market type.
CURRENCIES = [
    ("BRL", "LatAm", "EM"), ("MXN", "LatAm", "EM"), ("ZAR", "Africa", "EM"), ("TRY", "EMEA", "EM"), ("PLN", "CEE", "EM"),
    ("HUF", "CEE", "EM"), ("CZK", "CEE", "EM"), ("KRW", "Asia", "EM"), ("THB", "Asia", "EM"), ("INR", "Asia", "EM"),
    ("IDR", "Asia", "EM"), ("PHP", "Asia", "EM"), ("GBP", "Europe", "DM"), ("JPY", "Asia", "DM"), ("CHF", "Europe", "DM"),
    ("AUD", "Oceania", "DM"), ("CAD", "N. America", "DM"), ("SEK", "Europe", "DM"), ("NOK", "Europe", "DM"), ("MYR", "Asia", "EM"),
]

# Known currency crises (name, first day, last day), first overlap names an episode.
KNOWN_CRISES = [
    ("Brazilian/Argentine Crisis", "1999-01-01", "2002-06-30"), ("Subprime/Pre-GFC Turbulence", "2007-07-01", "2007-12-31"),
    ("Bear Stearns / Pre-GFC", "2008-03-01", "2008-06-30"), ("Global Financial Crisis", "2008-07-01", "2009-07-31"),
    ("European Sovereign Debt Crisis", "2010-04-01", "2012-06-30"), ("Taper Tantrum", "2013-05-01", "2013-12-31"),
    ("Commodity/China Crash", "2014-06-01", "2016-03-31"), ("Brexit Vote", "2016-06-20", "2016-08-31"),
    ("EM Crisis 2018", "2018-04-01", "2018-12-31"), ("COVID Crash", "2020-02-15", "2020-06-30"),
    ("Russia/Rate Shock", "2022-01-01", "2022-12-31"), ("Japan Unwind 2024", "2023-08-01", "2024-08-31"),
    ("Tariff Shock 2025", "2025-03-01", "2025-07-31"),
]


def currencies(spark: SparkSession) -> DataFrame:
    """position, ccy, region, market; positions count from 0."""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CURRENCIES)], "position int, ccy string, region string, market string")
