"""Line-oriented inputs: point attributes, field maps, name lists, index files, text cubes, layer info."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweft.sources.cube_files import read_files, write_files


def _numbers(line: Column) -> Column:
    return F.transform(F.split(line, ","), lambda s: F.trim(s).try_cast("double"))


def read_points(spark: SparkSession, path: str, fields: Sequence[str], bad_rows: bool = False) -> DataFrame:
    """Header line plus rows of numbers. Rows that do not parse are dropped, or returned alone with ``bad_rows``."""
    header = ",".join(fields)
    lines = spark.read.text(path).filter(F.col("value") != header)
    parsed = lines.withColumn("_v", _numbers(F.col("value")))
    good = (F.size("_v") == len(fields)) & F.forall("_v", lambda v: v.isNotNull())
    if bad_rows:
        return parsed.filter(~good).select(F.col("value").alias("line"))
    return parsed.filter(good).select(*[F.col("_v")[i].alias(f) for i, f in enumerate(fields)])


def write_points(df: DataFrame, path: str, fields: Sequence[str], mode: str = "errorifexists") -> None:
    """Write point attributes in the format that ``read_points`` takes."""
    df.select(*fields).write.mode(mode).csv(path, header=True)


def read_field_map(spark: SparkSession, path: str, names: Sequence[str] = ("file", "keyword", "field", "position")) -> DataFrame:
    """Lines ``key:a,b,c,d`` as integers."""
    parts = spark.read.text(path).filter(F.trim("value") != "").select(F.split("value", ":").alias("_p"))
    values = F.split(F.col("_p")[1], ",")
    return parts.select(
        F.trim(F.col("_p")[0]).cast("int").alias("key"),
        *[F.trim(values[i]).cast("int").alias(n) for i, n in enumerate(names)],
    )


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name per line, with or without a trailing comma."""
    name = F.trim(F.split("value", ",")[0])
    return spark.read.text(path).filter(F.trim("value") != "").select(name.alias("name"))


def read_index_text(spark: SparkSession, path: str, names: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Text matrix of ids written as floats, back to integers."""
    values = _numbers(F.col("value"))
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(*[F.round(values[i]).cast("bigint").alias(n) for i, n in enumerate(names)])


def write_index_text(df: DataFrame, path: str, names: Sequence[str] = ("sample_id",), mode: str = "errorifexists") -> None:
    """Ids as float text, one row per line."""
    line = F.concat_ws(",", *[F.format_string("%.18e", F.col(n).cast("double")) for n in names])
    df.select(line.alias("value")).write.mode(mode).text(path)


def read_cube_text(spark: SparkSession, path: str, layout: str = "hwc", key: str = "sample_id") -> DataFrame:
    """Text cubes, one file per sample in one folder: key (the number at the end of the file's name, if any), file, si, sj, channel, value.

    ``hwc`` files hold one line per pixel with a column per channel, ``chw`` files one line per channel with a column per
    pixel. The side of the (square) image follows from the number of pixels.
    """
    ident = F.regexp_extract("file", r"(^-[0-9]+|[0-9]+)(\.[A-Za-z]+)?$", 1).try_cast("bigint").alias(key)
    files = read_files(spark, path).select(ident, "file", "value")
    lines = files.selectExpr(key, "file", "filter(split(value, '\n'), s -> trim(s) <> '') AS _lines")
    rows = lines.selectExpr(key, "file", "size(_lines) AS _n", "posexplode(_lines) AS (_line, _text)")
    rows = rows.selectExpr(key, "file", "_n", "_line", "split(_text, ',') AS _v")
    cells = rows.selectExpr(key, "file", "_n", "_line", "size(_v) AS _m", "posexplode(_v) AS (_col, _t)")
    pixel, channel, total = ("_line", "_col", "_n") if layout == "hwc" else ("_col", "_line", "_m")
    side = f"int(round(sqrt({total})))"
    return cells.selectExpr(
        key,
        "file",
        f"int({pixel} div {side}) AS si",
        f"{pixel} % {side} AS sj",
        f"{channel} AS channel",
        "double(trim(_t)) AS value",
    )


def write_cube_text(df: DataFrame, path: str, layout: str = "hwc", key: str = "sample_id", mode: str = "errorifexists") -> None:
    """Text twin of a cube: one file per sample, named after it, in one folder and in the layout ``read_cube_text`` takes."""
    line, col = (("si", "sj"), ("channel",)) if layout == "hwc" else (("channel",), ("si", "sj"))
    cells = F.array_sort(F.collect_list(F.struct(*col, F.col("value").cast("string").alias("_v"))))
    rows = df.groupBy(key, *line).agg(F.array_join(F.transform(cells, lambda e: e["_v"]), ",").alias("_t"))
    lines = F.array_sort(F.collect_list(F.struct(*line, "_t")))
    text = rows.groupBy(key).agg(F.array_join(F.transform(lines, lambda e: e["_t"]), "\n").alias("value"))
    write_files(text.select(F.concat(F.col(key).cast("string"), F.lit(".csv")).alias("file"), "value"), path, mode)


def parse_info(spark: SparkSession, path: str) -> DataFrame:
    """Layer-info text: folds, fill, crs and seed of the header beside size, role, idx and name of every layer.

    The header may lack the seed.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.split("value", ",").alias("p"))
    # a layer line has x or y in second place
    is_layer = F.col("p")[1].isin("x", "y")
    header = lines.filter(~is_layer).select(
        F.col("p")[0].cast("int").alias("folds"),
        F.col("p")[1].cast("int").alias("buffer_fill"),
        F.col("p")[2].alias("crs"),
        F.get("p", F.lit(3)).cast("bigint").alias("seed"),
    )
    top = header.agg(F.first(F.struct(*header.columns))).scalar()
    layers = lines.filter(is_layer).select(
        F.col("p")[0].cast("int").alias("size"),
        F.col("p")[1].alias("role"),
        F.col("p")[2].cast("int").alias("idx"),
        F.col("p")[3].alias("name"),
    )
    return layers.withColumn("_h", top).select("size", "role", "idx", "name", "_h.*")


def write_info(layers: DataFrame, path: str, folds: int, fill: int, crs: str, seed: int | None = None, mode: str = "errorifexists") -> None:
    """Write the layer-info text; ``layers`` holds size, role, idx, name."""
    head = ",".join(str(v) for v in (folds, fill, crs, seed) if v is not None)
    line = F.concat_ws(",", "size", "role", "idx", "name")
    top = layers.sparkSession.range(1).select(F.lit(head).alias("value"), F.lit(-1).alias("_o"))
    body = layers.select(line.alias("value"), F.col("idx").alias("_o"))
    # a catalog is a few lines long
    top.unionByName(body).coalesce(1).sortWithinPartitions("_o").select("value").write.mode(mode).text(path)

