"""City gazetteer: a table of names, or the small built-in one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import folded

SCHEMA = "ord bigint, name string, countrycode string, population bigint, alternatenames array<string>"

#: Capitals and large cities of the countries in the country table (rounded populations, public knowledge).
CITIES = (
    ("Madrid", "ES", 3255944), ("Barcelona", "ES", 1621537), ("Valencia", "ES", 814208), ("Sevilla", "ES", 703206, "Seville"), ("Zaragoza", "ES", 674317), ("Málaga", "ES", 568305), ("Bilbao", "ES", 354860),
    ("Ciudad de México", "MX", 12294193, "Mexico City", "CDMX"), ("Guadalajara", "MX", 1495182), ("Monterrey", "MX", 1135512), ("Puebla", "MX", 1434062), ("Tijuana", "MX", 1810645), ("Mérida", "MX", 777615), ("Querétaro", "MX", 626495), ("Cancún", "MX", 628306), ("León", "MX", 1238962),
    ("Bogotá", "CO", 7674366), ("Medellín", "CO", 1999979), ("Cali", "CO", 2392877, "Santiago de Cali"), ("Barranquilla", "CO", 1380425), ("Cartagena", "CO", 914552), ("Bucaramanga", "CO", 571820), ("Pereira", "CO", 440118),
    ("Buenos Aires", "AR", 13076300), ("Córdoba", "AR", 1428214), ("Rosario", "AR", 1173533), ("Mendoza", "AR", 876884), ("La Plata", "AR", 694167),
    ("Lima", "PE", 7737002), ("Arequipa", "PE", 841130), ("Trujillo", "PE", 747450), ("Cusco", "PE", 428450, "Cuzco"),
    ("Santiago", "CL", 4837295, "Santiago de Chile"), ("Valparaíso", "CL", 282448), ("Concepción", "CL", 215413), ("Antofagasta", "CL", 309832),
    ("Quito", "EC", 1399814), ("Guayaquil", "EC", 1952029), ("Cuenca", "EC", 276964),
    ("Caracas", "VE", 3000000), ("Maracaibo", "VE", 2225000), ("Valencia", "VE", 1385083),
    ("Ciudad de Guatemala", "GT", 994938, "Guatemala City"), ("La Paz", "BO", 812799), ("Santa Cruz de la Sierra", "BO", 1364389, "Santa Cruz"), ("Cochabamba", "BO", 900414),
    ("Asunción", "PY", 1482200), ("Montevideo", "UY", 1270737), ("San José", "CR", 335007), ("Ciudad de Panamá", "PA", 408168, "Panama City"),
    ("Tegucigalpa", "HN", 850848), ("San Pedro Sula", "HN", 489466), ("San Salvador", "SV", 525990), ("Managua", "NI", 973087),
    ("Santo Domingo", "DO", 2201941), ("San Juan", "PR", 418140), ("La Habana", "CU", 2163824, "Havana"),
    ("New York City", "US", 8175133, "New York", "Nueva York"), ("Los Angeles", "US", 3971883), ("Miami", "US", 441003), ("Houston", "US", 2296224), ("Chicago", "US", 2720546),
    ("São Paulo", "BR", 10021295), ("Rio de Janeiro", "BR", 6023699), ("Brasília", "BR", 2207718), ("Lisboa", "PT", 517802, "Lisbon"), ("Porto", "PT", 249633, "Oporto"),
)


def builtin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c[0], c[1], c[2], list(c[3:])) for i, c in enumerate(CITIES)], SCHEMA)


def from_table(spark: SparkSession, path: str) -> DataFrame:
    """Cities out of a file in the layout of the public GeoNames city tables (tab-separated, no header), in file order.

    Columns by position: 1 name, 3 other spellings (comma-separated), 8 country code, 14 population.
    """
    raw = spark.read.csv(path, sep="\t", quote="", header=False)
    return raw.select(
        F.monotonically_increasing_id().alias("ord"), F.col("_c1").alias("name"), F.col("_c8").alias("countrycode"), F.coalesce(F.col("_c14").cast("bigint"), F.lit(0)).alias("population"),
        F.when(F.col("_c3").isNotNull(), F.split("_c3", ",")).otherwise(F.array().cast("array<string>")).alias("alternatenames"),
    ).where("name IS NOT NULL")


def keyed(cities: DataFrame) -> DataFrame:
    """One row per spelling (``key``, ``name`` as spelt, ``countrycode``, ``population``, ``ord``); short and non-Latin spellings go."""
    spelt = cities.select("countrycode", "population", "ord", F.posexplode(F.concat(F.array("name"), F.coalesce("alternatenames", F.array().cast("array<string>")))).alias("alt", "name"))
    kept = spelt.where((F.length("name") >= 3) & F.col("name").rlike(fixed.CITY_NAME))
    return kept.select(folded(F.col("name")).alias("key"), "name", "countrycode", "population", (F.col("ord").cast("decimal(30,0)") * 10_000 + F.col("alt")).alias("ord"))
