"""XML feeds: warning lists and documents, seismic bulletins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AREA = "struct<areaDesc:string,polygon:array<string>>"
INFO = f"struct<language:string,category:string,event:string,urgency:string,severity:string,certainty:string,effective:string,onset:string,expires:string,senderName:string,headline:string,description:string,instruction:string,area:array<{AREA}>>"
ALERT = f"struct<identifier:string,sender:string,sent:string,status:string,msgType:string,references:string,info:array<{INFO}>>"


def warning_list(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, repeated) of an RSS feed, each with a digest of its fields."""
    item = "struct<title:string,link:string,description:string,author:string,pubDate:string,guid:string>"
    i = raw.withColumn("i", F.explode(F.from_xml("body", f"struct<channel:struct<item:array<{item}>>>")["channel"]["item"])).select("path", "i.*")
    fields = [F.concat(F.octet_length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit(""))) for c in ("guid", "title", "link", "description", "pubDate")]
    i = i.filter(F.coalesce("guid", F.lit("")) != "").withColumn("digest", F.sha2(F.concat(*fields), 256))
    n = i.withColumn("_n", F.row_number().over(Window.partitionBy("path", "guid").orderBy("digest")))
    return n.filter("_n = 1").drop("_n"), n.filter("_n > 1").drop("_n")


def polygon(c):
    """'lat,lon lat,lon' to points."""
    pts = F.filter(F.split(F.trim(c), r"\s+"), lambda p: p != "")
    return F.transform(pts, lambda p: F.struct(F.split_part(p, F.lit(","), F.lit(1)).try_cast("double").alias("lat"), F.split_part(p, F.lit(","), F.lit(2)).try_cast("double").alias("lon")))


def warnings(raw: DataFrame, fetched_at, language: str = "id") -> DataFrame:
    """Typed messages of CAP documents: the block in ``language``, else the first; a text of each language."""
    a = raw.withColumn("a", F.from_xml("body", ALERT)).withColumn("infos", F.coalesce("a.info", F.array().cast(f"array<{INFO}>")))
    own = F.filter("infos", lambda i: F.coalesce(i["language"], F.lit("")).startswith(language))
    a = a.withColumn("i", F.coalesce(F.get(own, F.lit(0)), F.get(F.col("infos"), F.lit(0))))
    ts = F.try_to_timestamp
    lang = F.transform("infos", lambda i: i["language"])
    texts = F.transform(F.filter("infos", lambda i, k: F.array_position(lang, i["language"]) == k + 1), lambda i: F.struct(i["language"].alias("language"), i["event"].alias("event"), i["headline"].alias("headline"), i["description"].alias("description"), i["instruction"].alias("instruction"), i["senderName"].alias("sender_name")))
    ref = F.filter(F.split(F.trim(F.coalesce("a.references", F.lit(""))), r"\s+"), lambda r: r != "")
    refs = F.array_sort(F.transform(ref, lambda r: F.struct(F.split_part(r, F.lit(","), F.lit(2)).alias("identifier"), F.split_part(r, F.lit(","), F.lit(1)).alias("sender"), ts(F.split_part(r, F.lit(","), F.lit(3))).alias("sent"))))
    areas = F.coalesce("i.area", F.array().cast(f"array<{AREA}>"))
    return a.select(
        "path", F.col("a.identifier").alias("identifier"), F.col("a.sender").alias("sender"), ts("a.sent").alias("sent"), F.col("a.status").alias("status"), F.col("a.msgType").alias("msg_type"), refs.alias("references"),
        F.col("i.category").alias("category"), F.col("i.urgency").alias("urgency"), F.col("i.severity").alias("severity"), F.col("i.certainty").alias("certainty"),
        F.coalesce(ts("i.effective"), ts("a.sent")).alias("effective"), ts("i.onset").alias("onset"), ts("i.expires").alias("expires"), texts.alias("texts"),
        F.array_join(F.array_distinct(F.transform(areas, lambda x: x["areaDesc"])), ", ").alias("area_desc"),
        F.transform(F.flatten(F.transform(areas, lambda x: F.coalesce(x["polygon"], F.array().cast("array<string>")))), polygon).alias("polygons"), fetched_at.alias("fetched_at"), fetched_at.alias("first_seen_at"),
    )


REAL, TIME = "struct<value:double>", "struct<value:string>"
MAGNITUDE = f"struct<mag:{REAL},type:string,originID:string,creationInfo:struct<agencyID:string,author:string>>"
ORIGIN = f"struct<_publicID:string,time:{TIME},latitude:{REAL},longitude:{REAL},depth:{REAL},creationInfo:struct<agencyID:string,author:string>>"


def bulletins(raw: DataFrame) -> DataFrame:
    """Origins of QuakeML events with their magnitudes; depth in kilometres; the agency falls back to the author."""
    e = f"struct<_publicID:string,origin:array<{ORIGIN}>,magnitude:array<{MAGNITUDE}>>"
    q = raw.withColumn("e", F.explode(F.from_xml("body", f"struct<eventParameters:struct<event:array<{e}>>>")["eventParameters"]["event"]))
    q = q.select("path", F.col("e._publicID").alias("event"), F.posexplode("e.origin").alias("pos", "o"), F.col("e.magnitude").alias("m"))
    own = F.filter("m", lambda m: m["originID"] == F.col("o._publicID"))
    who = lambda c: F.coalesce(F.nullif(F.col(f"{c}.creationInfo.agencyID"), F.lit("")), F.col(f"{c}.creationInfo.author"))
    return q.withColumn("x", F.explode_outer(own)).select(
        "path", "event", "pos", F.col("o._publicID").alias("origin_id"), who("o").alias("agency"), who("x").alias("author"), F.try_to_timestamp("o.time.value").alias("occurred_at"),
        F.col("o.latitude.value").alias("lat"), F.col("o.longitude.value").alias("lon"), (F.col("o.depth.value") / 1000).alias("depth_km"), F.col("x.mag.value").alias("magnitude"), F.col("x.type").alias("magnitude_type"),
    )
