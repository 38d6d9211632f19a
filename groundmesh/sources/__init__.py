"""Sources: typed scans, text series, catalogues and polygons read by name and with tolerant casts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType, key: list[str], fmt: str = "csv") -> DataFrame:
    """A table under a fixed schema; missing columns, an empty input and repeated keys are errors."""
    df = spark.read.schema(schema).options(header=True, enforceSchema=False).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    absent = set(schema.fieldNames()) - set(df.columns)
    if absent:
        raise ValueError(f"{path} lacks {sorted(absent)}")
    df = df.select(*schema.fieldNames())
    if df.isEmpty():
        raise ValueError(f"{path} is empty")
    twice = df.groupBy(*key).count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"{path} repeats keys, as {twice[0]}")
    return df


def read_station_series(spark: SparkSession, path: str, date: str = "YYMMMDD", up: str = "____up(m)", sigma: str = "sig_u(m)") -> DataFrame:
    """station, date, up_m, sig_up_m of whitespace files whose columns are found by their names in the header."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\s+").alias("p"))
    heads = lines.where(F.array_contains("p", date)).groupBy("file").agg(F.first("p").alias("names"))
    at = lambda name: F.try_element_at("p", F.array_position("names", F.lit(name)).cast("int"))
    rows = lines.where(~F.array_contains("p", date)).join(heads, "file")
    return rows.select(
        F.col("p")[0].alias("station"), F.to_date(F.try_to_timestamp(F.initcap(at(date)), F.lit("yyMMMdd"))).alias("date"), at(up).try_cast("double").alias("up_m"), at(sigma).try_cast("double").alias("sig_up_m"),
    ).where("date is not null")


def read_catalogue(spark: SparkSession, path: str, lat: float, lon: float, radius_km: float) -> DataFrame:
    """station, lat, lon, km of catalogue lines with at least three fields that parse, within the radius."""
    from ..operators.geo import haversine_km

    p = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 3)
    rows = p.select(F.col("p")[0].alias("station"), F.col("p")[1].try_cast("double").alias("lat"), F.col("p")[2].try_cast("double").alias("lon")).where("lat is not null and lon is not null")
    rows = rows.withColumn("lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")))
    return rows.withColumn("km", haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).where(F.col("km") <= radius_km)


def read_telemetry(spark: SparkSession, path: str, producer: str, time_column: str = "Data Acquisition Time", station: str = "Station") -> DataFrame:
    """producer, station, ts, value; the value is the column after the acquisition time. What does not parse is null."""
    df = spark.read.options(header=True).csv(path)
    value = df.columns[df.columns.index(time_column) + 1]
    return df.select(F.lit(producer).alias("producer"), F.col(f"`{station}`").alias("station"), F.try_to_timestamp(F.col(f"`{time_column}`"), F.lit("dd-MM-yyyy HH:mm")).alias("ts"), F.col(f"`{value}`").try_cast("double").alias("value"))


def extract_station_rows(text: DataFrame, bbox: tuple[float, float, float, float], margin: float = 0.25) -> DataFrame:
    """Station rows in report text (a column ``value``): name, latitude, longitude, depth (the last decimal), well type.

    bbox: south, west, north, east in degrees.
    """
    row = r"^\s*\d*\s*([A-Za-z][A-Za-z .'-]+?)\s+(\d{2}\.\d+)\s+(\d{2,3}\.\d+)\b"
    part = lambda i: F.regexp_extract("value", row, i)
    numbers = F.regexp_extract_all("value", F.lit(r"(\d+\.\d+)"), 1)
    kind = F.when(F.lower("value").contains("dug"), "dug").when(F.lower("value").contains("tube") | F.lower("value").contains("bore"), "tube").otherwise("unknown")
    out = text.where(F.col("value").rlike(row)).select(part(1).alias("name"), part(2).cast("double").alias("lat"), part(3).cast("double").alias("lon"), F.when(F.size(numbers) > 2, F.element_at(numbers, -1).cast("double")).alias("depth"), kind.alias("well_type"))
    s, w, n, e = bbox
    return out.where(F.col("lat").between(s - margin, n + margin) & F.col("lon").between(w - margin, e + margin))


ITEM = "GranuleUR string, Platforms array<struct<ShortName string>>, RelatedUrls array<struct<URL string>>, AdditionalAttributes array<struct<Name string, Values array<string>>>"


def flatten_catalogue(items: DataFrame, names: list[str], column: str = "json") -> DataFrame:
    """Nested catalogue items as flat records: granule, first platform, first .tiff address and the named attributes."""
    x = items.select(F.from_json(column, ITEM).alias("x"))
    value = lambda n: F.try_element_at(F.try_element_at(F.filter("x.AdditionalAttributes", lambda a: a["Name"] == n), F.lit(1))["Values"], F.lit(1))
    return x.select(
        F.col("x.GranuleUR").alias("granule"), F.try_element_at("x.Platforms", F.lit(1))["ShortName"].alias("platform"),
        F.try_element_at(F.filter("x.RelatedUrls", lambda u: u["URL"].endswith(".tiff")), F.lit(1))["URL"].alias("url"), *[value(n).alias(n.lower()) for n in names],
    )


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """poly_id, x1, y1, x2, y2 of the polygons in a GeoJSON feature collection; rings close themselves."""
    schema = "features array<struct<properties map<string, string>, geometry struct<type string, coordinates array<array<array<double>>>>>>"
    f = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", schema)["features"]).alias("i", "f"))
    return _ring_edges(f.select(F.coalesce(F.try_element_at("f.properties", F.lit("id")), F.col("i").cast("string")).alias("poly_id"), F.posexplode("f.geometry.coordinates").alias("ring", "c")))


def polygons_from_wkt(df: DataFrame, key: str, column: str = "wkt") -> DataFrame:
    """poly_id, x1, y1, x2, y2 of POLYGON and MULTIPOLYGON texts, one a row; other kinds and nulls give no rows."""
    rings = df.where(F.upper(F.trim(column)).rlike("^(MULTI)?POLYGON")).select(F.col(key).cast("string").alias("poly_id"), F.posexplode(F.regexp_extract_all(column, F.lit(r"\(([^()]+)\)"), 1)).alias("ring", "r"))
    point = lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda v: v.try_cast("double"))
    return _ring_edges(rings.select("poly_id", "ring", F.transform(F.split("r", ","), point).alias("c")))


def _ring_edges(ring: DataFrame) -> DataFrame:
    n = F.size("c")
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get("c", i)[0].alias("x1"), F.get("c", i)[1].alias("y1"), F.get("c", i + 1)[0].alias("x2"), F.get("c", i + 1)[1].alias("y2")))
    return ring.where(n >= 2).select("poly_id", F.explode(pairs).alias("e")).select("poly_id", "e.*")


def scan_pixels(spark: SparkSession, path: str, stack: str, rows: tuple[int, int], cols: tuple[int, int], columns: list[str]) -> DataFrame:
    """Pixels of one stack in a window: the partition is pruned and rows and columns are pushed to the scan."""
    return spark.read.parquet(path).where((F.col("stack") == stack) & F.col("row").between(*rows) & F.col("col").between(*cols)).select("row", "col", *columns)


def files_to_dates(spark: SparkSession, path: str, least_bytes: int = 1024) -> DataFrame:
    """date and hour that file names of the form ..._YYYYMMDD_HH.grb carry, of files that are large enough."""
    f = spark.read.format("binaryFile").load(path).select("path", "length")
    return f.where(F.col("length") >= least_bytes).select(F.try_to_timestamp(F.regexp_extract("path", r"_(\d{8})_(\d{2})\.grb$", 1), F.lit("yyyyMMdd")).cast("date").alias("date"), F.regexp_extract("path", r"_(\d{8})_(\d{2})\.grb$", 2).try_cast("int").alias("hour")).where("date is not null")


def monthly_series(df: DataFrame, first: str, last: str) -> DataFrame:
    """Month, total in mm (from metres a day) inside a period; df: ts, m_per_day."""
    month = F.trunc("ts", "MM")
    clipped = df.where(F.col("ts").between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")))
    return clipped.groupBy(month.alias("month")).agg((F.avg("m_per_day") * F.dayofmonth(F.last_day(F.first(month))) * 1000).alias("mm"))


def climatology(months: DataFrame) -> DataFrame:
    """Mean and number of each month of the year; months: month, mm."""
    return months.groupBy(F.month("month").alias("month_of_year")).agg(F.count("mm").alias("n"), F.avg("mm").alias("mean_mm"))


def yearly_trend(months: DataFrame) -> DataFrame:
    """Change of the monthly totals in mm a month for each year, by least squares over the months."""
    return months.agg(F.count("mm").alias("n"), (12 * F.regr_slope("mm", F.year("month") * 12 + F.month("month"))).alias("mm_per_year"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None) -> None:
    w = df.write.mode(mode).options(header=True) if fmt == "csv" else df.write.mode(mode)
    (w.partitionBy(*by) if by else w).format(fmt).save(path)


def append_ledger(df: DataFrame, path: str) -> None:
    """Append rows to a ledger; nothing ever rewrites it."""
    df.write.mode("append").parquet(path)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of all files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
