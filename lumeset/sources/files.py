"""Files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

#: Suffixes of the files that are looked for
VIDEO_SUFFIXES = ("mp4", "mkv", "mov", "avi", "webm", "m4v", "flv", "ts", "mts", "m2ts", "wmv", "mpg", "mpeg")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp")


def natural_key(name: Column) -> Column:
    """Lower case with runs of digits padded, so that it sorts as numbers do (up to 20 digits)."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p)), "")


def scan(spark: SparkSession, folder: str, suffixes=VIDEO_SUFFIXES, recursive: bool = False) -> DataFrame:
    """path, name, size, mtime, ord of the files in a folder with one of the suffixes, whatever their case; ord follows the natural order of names.

    Contents are not read. Raises if the folder does not exist.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder if recursive else f"{folder.rstrip('/')}/*")
    if not recursive:  # a pattern also opens the folders that it matches
        plain = lambda x: F.regexp_replace(x, r"^\w+:/+", "/")
        files = files.where(F.regexp_replace(plain(F.col("path")), "/[^/]*$", "") == plain(F.lit(folder.rstrip("/"))))
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.select("path", name.alias("name"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))
    kept = kept.where(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*suffixes))
    # names are few beside contents, so numbering them all in one task is no burden
    return kept.withColumn("ord", F.row_number().over(W.orderBy(natural_key(F.col("name")), "path")) - 1)


def first_video_stream(reply: Column) -> Column:
    """Struct of the first video stream of a probe's JSON that is no attached picture: index, width, height, codec, rate, duration, start."""
    schema = "streams array<struct<index:int,codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,duration:string,start_time:string,disposition:struct<attached_pic:int>>>, format struct<duration:string,start_time:string>"
    doc = F.from_json(reply, schema)
    s = F.get(F.filter(doc["streams"], lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0)), F.lit(0))
    number = lambda x: x.try_cast("double")
    start = F.greatest(F.lit(0.0), F.coalesce(number(s["start_time"]), F.lit(0.0)) - F.coalesce(number(doc["format"]["start_time"]), F.lit(0.0)))
    own = number(s["duration"])
    duration = F.when(own > 0, own).otherwise(number(doc["format"]["duration"]) - start)
    return F.struct(s["index"].alias("index"), s["width"].alias("width"), s["height"].alias("height"), s["codec_name"].alias("codec"), s["avg_frame_rate"].alias("rate"), duration.alias("duration"), start.alias("start"))


def last_frame(packets: DataFrame, key: str = "key") -> DataFrame:
    """key, last: the latest pts (dts where there is none) of a source less its format start; null if that is before its start."""
    t = F.max(F.coalesce("pts", "dts")) - F.first("format_start")
    return packets.groupBy(key).agg(F.when(t >= F.first("start"), t).alias("last"))
