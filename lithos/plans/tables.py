"""Latest-wins, validation, region, text and bookkeeping queries over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos.functions import ids, text
from lithos.functions.geo import round_half_up
from lithos.functions.levels import severity_level
from lithos.operators import joins, latest, names, quality, regions, series, weather
from lithos.plans.registry import EVENTS_SQL, detections, micros, query
from lithos.session import checkpoint_dir, cut, read_table
from lithos.sources import tabular
from lithos.streaming import warnings as warning_state


@query("""SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1""")
def latest_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").alias("issued"))
    return latest.latest_issue(li, ["l_partkey"], "issued").drop("issued")


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0),
n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'inserted' WHEN n.o_orderkey IS NULL THEN 'deleted'
  WHEN o.o_totalprice IS NOT DISTINCT FROM n.o_totalprice AND o.o_orderstatus IS NOT DISTINCT FROM n.o_orderstatus THEN 'unchanged' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    new = o.filter(k % 7 != 0).withColumn("o_totalprice", F.when(k % 5 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return latest.snapshot_diff(o.filter(k % 10 != 0), new, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query("""WITH a AS (SELECT o_orderkey, 1 AS version, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 2 = 0 UNION ALL
  SELECT o_orderkey, 2 - o_orderkey % 2 * 2, o_totalprice + 5, o_orderdate - INTERVAL 1 DAY FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_orderkey, max(version) AS version, arg_max(o_totalprice, version) AS o_totalprice, epoch_us(min(o_orderdate)) AS first_us FROM a GROUP BY o_orderkey""")
def idempotent_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    stored = o.filter(k % 2 == 0).select("o_orderkey", F.lit(1).cast("long").alias("version"), "o_totalprice", "o_orderdate")
    late = o.filter(k % 3 == 0).select("o_orderkey", (2 - k % 2 * 2).alias("version"), (F.col("o_totalprice") + 5).alias("o_totalprice"), (F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).alias("o_orderdate"))
    out = latest.upsert(stored, late, ["o_orderkey"], ["version"], ["o_orderdate"])
    return out.select("o_orderkey", "version", "o_totalprice", micros("o_orderdate").alias("first_us"))


@query("""WITH b AS (SELECT o_orderkey AS id, o_totalprice AS d, 'active' AS s FROM orders WHERE o_orderkey % 4 <> 0),
a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS d, CASE WHEN o_orderkey % 11 = 0 THEN 'merged' ELSE 'active' END AS s FROM orders WHERE o_orderkey % 5 <> 0)
SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'created' WHEN a.id IS NULL THEN 'expired' WHEN a.s <> b.s AND a.s <> 'active' THEN a.s WHEN a.d <> b.d THEN 'updated' END AS transition,
  CASE WHEN b.id IS NULL THEN 1 ELSE 8 END AS revision FROM a FULL JOIN b ON a.id = b.id) WHERE transition IS NOT NULL""")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    k, p = F.col("id"), F.col("o_totalprice")
    before = o.filter(k % 4 != 0).select("id", p.alias("digest"), F.lit("active").alias("status"), F.lit(7).alias("revision"))
    after = o.filter(k % 5 != 0).select("id", F.when(k % 3 == 0, p + 1).otherwise(p).alias("digest"), F.when(k % 11 == 0, "merged").otherwise("active").alias("status"))
    return latest.change_log(before, after, "id", "digest")


@query("""SELECT l.l_orderkey, l.l_linenumber, o.o_orderkey AS asof_order FROM (SELECT *, l_suppkey % 50 AS k FROM lineitem) l
  ASOF LEFT JOIN (SELECT o_custkey % 50 AS k, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON l.k = o.k AND l.l_shipdate >= o.o_orderdate""")
def asof_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 50).alias("k"), "l_shipdate")
    o = read_table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("k"), "o_orderdate").agg(F.max("o_orderkey").alias("asof_order"))
    return joins.as_of(li, o, "k", "l_shipdate", "o_orderdate", "asof_order").select("l_orderkey", "l_linenumber", "asof_order")


@query("""WITH RECURSIVE m AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ref FROM orders), e AS (SELECT id AS a, ref AS b FROM m WHERE ref IS NOT NULL),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(id, node) AS (SELECT id, id FROM m UNION SELECT r.id, s.b FROM r JOIN s ON r.node = s.a)
SELECT id, min(node) AS chain FROM r GROUP BY id""")
def warning_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages that refer to their customer's order before."""
    o = read_table(spark, sf_dir, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    m = o.select(F.col("o_orderkey").alias("identifier"), before.alias("_r")).select("identifier", F.array_compact(F.array(F.when(F.col("_r").isNotNull(), F.struct(F.col("_r").alias("identifier"))))).alias("references"))
    return weather.chains(m).select(F.col("identifier").alias("id"), "chain")


#: Orders as messages: each refers to its customer's order before, some cancel, some have no area.
_MESSAGES_SQL = """m AS (SELECT o_custkey AS c, CAST(o_orderkey AS VARCHAR) AS i, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS sent, o_orderkey % 7 = 0 AS cancels, o_orderkey % 3 > 0 AS has_area,
  date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 400 AS expires_at, CAST(1 + o_orderkey % 4 AS INTEGER) AS level FROM orders)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k, sent = F.col("o_orderkey"), F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01")).cast("long")
    before = F.lag(F.struct(k.cast("string").alias("identifier"), sent.alias("sent"))).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    refs = F.array_compact(F.array(before))
    area = F.when(k % 3 > 0, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>"))
    return o.select(
        k.cast("string").alias("identifier"), sent.alias("sent"), F.concat(F.lit("d"), k.cast("string")).alias("digest"), F.when(k % 7 == 0, "Cancel").otherwise("Update").alias("msg_type"), refs.alias("references"), area.alias("polygons"),
        F.lit(True).alias("relevant"), sent.alias("onset"), sent.alias("effective"), (sent + k % 400).alias("expires_at"), (1 + k % 4).cast("int").alias("level"), sent.alias("first_seen_at"), (k % 3).alias("turn"),
    )


@query(f"""WITH {_MESSAGES_SQL}, g AS (SELECT c, arg_min(i, (sent, i)) AS event, arg_max(i, (sent, i)) AS current, arg_max(cancels, (sent, i)) AS cancelled, arg_max(expires_at, (sent, i)) FILTER (has_area) AS expires_at,
  arg_max(level, (sent, i)) FILTER (has_area) AS level, count(*) AS n_messages FROM m GROUP BY c)
SELECT event, current, CASE WHEN cancelled THEN 'retracted' WHEN expires_at <= 10400 THEN 'expired' ELSE 'active' END AS status, level, expires_at, n_messages FROM g WHERE expires_at IS NOT NULL""")
def warning_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in being after three batches, of which each holds a third of every chain, so links between chains come late."""
    state = warning_state.WarningState(spark, f"{checkpoint_dir(spark)}/warnings-{uuid.uuid4().hex}", 8)
    messages = cut(_messages(spark, sf_dir))
    for turn in range(3):
        warning_state.step(state, messages.filter(F.col("turn") == turn), turn, 10_400)
    return state.events.read(3).filter("status <> 'merged'").select("event", "current", "status", "level", "expires_at", "n_messages")


@query("""WITH h AS (SELECT event_id, substr(sha256('fire' || chr(0) || CAST(event_id AS VARCHAR)), 1, 64) AS s FROM events)
SELECT event_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-8' || substr(s, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(s, 17, 1)) - 1) % 4 + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS uuid FROM h""")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", ids.fire_event_id(F.col("event_id")).alias("uuid"))


@query("""SELECT event_id, substr(sha256(strlen(event_type) || ':' || event_type || strlen(CAST(user_id AS VARCHAR)) || ':' || CAST(user_id AS VARCHAR) || strlen(props) || ':' || props), 1, 32) AS message_id FROM events""")
def message_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", ids.message_id(F.col("event_type"), F.col("user_id").cast("string"), F.col("props")).alias("message_id"))


_VIOLATIONS_SQL = """WITH v AS (SELECT event_id, list_filter([CASE WHEN value > 480 THEN 'value' END, CASE WHEN user_id % 9 = 0 THEN 'user' END, CASE WHEN octet_length(encode(props)) > 8 AND event_type = 'error' THEN 'props' END], lambda x: x IS NOT NULL) AS e FROM events)"""


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"value": F.col("value") > 480, "user": F.col("user_id") % 9 == 0, "props": (F.octet_length("props") > 8) & (F.col("event_type") == "error")}
    return quality.with_errors(read_table(spark, sf_dir, "events"), rules)


@query(_VIOLATIONS_SQL + " SELECT event_id, array_to_string(e, ',') AS errors FROM v WHERE len(e) > 0")
def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.split(_violations(spark, sf_dir))[1].select("event_id", F.array_join("errors", ",").alias("errors"))


@query(_VIOLATIONS_SQL + """, x AS (SELECT unnest(e) AS reason, CAST(event_id AS VARCHAR) AS id FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY id) AS k FROM x)
SELECT reason, count(*) AS n, string_agg(id, ',' ORDER BY id) FILTER (k <= 10) AS examples FROM k GROUP BY reason""")
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.report(quality.split(_violations(spark, sf_dir))[1], "event_id")
    return out.select("reason", "n", F.array_join("examples", ",").alias("examples"))


_NATION_SQL = """c AS (SELECT DISTINCT x.code FROM (SELECT lpad(CAST(11 + r_regionkey AS VARCHAR), 2, '0') AS code FROM region
  UNION ALL SELECT lpad(CAST(11 + n_regionkey AS VARCHAR), 2, '0') || '.' || lpad(CAST(60 + n_nationkey AS VARCHAR), 2, '0') FROM nation WHERE n_nationkey % 6 <> 5
  UNION ALL SELECT lpad(CAST(11 + n_regionkey AS VARCHAR), 2, '0') || '.' || lpad(CAST(60 + n_nationkey AS VARCHAR), 2, '0') || '.0' || CAST(1 + s_suppkey % 3 AS VARCHAR) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT lpad(CAST(11 + n_regionkey AS VARCHAR), 2, '0') || '.' || lpad(CAST(60 + n_nationkey AS VARCHAR), 2, '0') || '.0' || CAST(1 + c_custkey % 4 AS VARCHAR) || '.' || CAST(1 + c_custkey % 2 AS VARCHAR) || lpad(CAST(c_custkey % 100 AS VARCHAR), 3, '0')
    FROM customer JOIN nation ON c_nationkey = n_nationkey) x)"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read_table(spark, sf_dir, n)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    prov, reg = two(11 + F.col("n_regionkey")), two(60 + F.col("n_nationkey"))
    n = F.broadcast(t("nation"))  # a fixed 25 rows
    s = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    c = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return (
        t("region").select(two(11 + F.col("r_regionkey")).alias("code"))
        .unionByName(t("nation").filter("n_nationkey % 6 <> 5").select(F.concat_ws(".", prov, reg).alias("code")))
        .unionByName(s.select(F.concat_ws(".", prov, reg, F.concat(F.lit("0"), (1 + F.col("s_suppkey") % 3).cast("string"))).alias("code")))
        .unionByName(c.select(F.concat_ws(".", prov, reg, F.concat(F.lit("0"), (1 + k % 4).cast("string")), F.concat((1 + k % 2).cast("string"), F.lpad((k % 100).cast("string"), 3, "0"))).alias("code")))
        .distinct()
    )


@query(f"""WITH {_NATION_SQL} SELECT code, len(string_split(code, '.')) AS level, CASE WHEN contains(code, '.') THEN regexp_replace(code, '\\.[0-9]+$', '') END AS parent_code,
  CASE len(string_split(code, '.')) WHEN 1 THEN 'province' WHEN 2 THEN CASE WHEN split_part(code, '.', 2) >= '71' THEN 'city' ELSE 'regency' END WHEN 3 THEN 'district'
  ELSE CASE WHEN split_part(code, '.', 4)[1] = '1' THEN 'urban_village' ELSE 'village' END END AS kind FROM c""")
def region_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("code")
    return _codes(spark, sf_dir).select("code", regions.level(c).alias("level"), regions.parent(c).alias("parent_code"), regions.kind(c).alias("kind"))


@query(f"""WITH RECURSIVE {_NATION_SQL}, g(code) AS (SELECT code FROM c WHERE NOT contains(code, '.') UNION SELECT c.code FROM c JOIN g ON regexp_replace(c.code, '\\.[0-9]+$', '') = g.code)
SELECT code FROM c WHERE code NOT IN (SELECT code FROM g)""")
def region_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.orphans(_codes(spark, sf_dir)).select("code")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 700 ORDER BY c_custkey LIMIT 50")
def region_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page after a cursor; the limit is the feature."""
    return regions.page(read_table(spark, sf_dir, "customer"), 700, 50, "c_custkey").select("c_custkey", "c_name")


_SQUARES_SQL = "q AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS code, 106.3 + (s_suppkey * 41 % 40) / 16.0 AS w, -7.9 + (s_suppkey * 23 % 32) / 16.0 AS s, (1 + s_suppkey % 5) / 8.0 AS size FROM supplier)"


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    w, s, z = F.lit(106.3) + (k * 41 % 40) / 16.0, F.lit(-7.9) + (k * 23 % 32) / 16.0, (1 + k % 5) / 8.0
    at = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    ring = F.array(at(w, s), at(w + z, s), at(w + z, s + z), at(w, s + z), at(w, s))
    return read_table(spark, sf_dir, "supplier").select(F.lpad(k.cast("string"), 5, "0").alias("code"), F.array(F.array(ring)).alias("geom"))


@query(f"WITH {EVENTS_SQL}, {_SQUARES_SQL}, j AS (SELECT id, code, row_number() OVER (PARTITION BY id ORDER BY floor(size * size * 1e9), code) AS k FROM h JOIN q ON lon BETWEEN w AND w + size AND lat BETWEEN s AND s + size) SELECT h.id, j.code FROM h LEFT JOIN j ON j.id = h.id AND j.k = 1")
def region_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.region_of(detections(spark, sf_dir), _squares(spark, sf_dir)).select("id", "code")


@query(f"""WITH {EVENTS_SQL}, {_SQUARES_SQL}, j AS (SELECT id, code, greatest(w - lon, 0, lon - w - size) * cos(radians(lat)) AS dx, greatest(s - lat, 0, lat - s - size) AS dy FROM h, q)
SELECT id, code, floor(sqrt(dx * dx + dy * dy) * pi() / 180 * 6371.0088 * 1000 + 0.5) / 1000 AS km FROM j WHERE sqrt(dx * dx + dy * dy) * pi() / 180 * 6371.0088 <= 20""")
def regions_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a query point, against all regions."""
    p = detections(spark, sf_dir).select("id", "lon", "lat")
    return regions.regions_within(p, _squares(spark, sf_dir), 20.0).select("id", "code", round_half_up(F.col("km"), 3).alias("km"))


@query(f"""WITH {_SQUARES_SQL} SELECT code, floor(size * size * 1e6 + 0.5) / 1e6 AS area, floor(w * 1e6 + 0.5) / 1e6 AS west, floor((s + size) * 1e6 + 0.5) / 1e6 AS north FROM q""")
def region_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("geom")
    b = regions.bbox(g)
    return _squares(spark, sf_dir).select("code", round_half_up(regions.planar_area(g), 6).alias("area"), round_half_up(b[0], 6).alias("west"), round_half_up(b[3], 6).alias("north"))


@query(f"""WITH {_SQUARES_SQL}, o AS (SELECT a.code AS id, b.code AS code, greatest(0, least(a.w + a.size, b.w + b.size) - greatest(a.w, b.w)) * greatest(0, least(a.s + a.size, b.s + b.size) - greatest(a.s, b.s)) / (b.size * b.size) AS x FROM q a, q b),
r AS (SELECT id, code, floor(x * 1e6 + 0.5) / 1e6 AS share FROM o WHERE x > 1e-9) SELECT *, row_number() OVER (PARTITION BY id ORDER BY share DESC, code) AS place FROM r""")
def region_coverage_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered regions of each shape, the most covered first."""
    sq = _squares(spark, sf_dir)
    ranked = lambda found: regions.ranked_coverage(found.withColumn("share", round_half_up(F.col("share"), 6))).withColumn("place", F.col("place").cast("long"))
    return regions.coverage(sq.select(F.col("code").alias("id"), "geom"), sq, then=ranked)


@query()
def region_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact shares of all pairs of regions that overlap."""
    sq = _squares(spark, sf_dir)
    return regions.coverage(sq.select(F.col("code").alias("id"), "geom"), sq)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, floor(value * 100 + 0.5) / 100 AS value FROM events")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return e.select("event_id", F.col("p.k").alias("k"), "event_type", round_half_up(F.col("value"), 2).alias("value"))


#: White space as Java's regular expressions have it: the SQL names the same characters.
_WS = r"[ \t\n\x0B\f\r]+"


@query(rf"""SELECT doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g'), ' ') AS squashed, length(trim(regexp_replace(text, '{_WS}', ' ', 'g'), ' ')) AS n FROM documents""")
def text_squash(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.squash(F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", s.alias("squashed"), F.length(s).cast("long").alias("n"))


@query("""SELECT event_id, day(t) || ' ' || ['Jan', 'Feb', 'Mar', 'Apr', 'Mei', 'Jun', 'Jul', 'Agu', 'Sep', 'Okt', 'Nov', 'Des'][month(t)] || ' ' || year(t) || ' ' || strftime(t, '%H.%M') || ' WIB' AS said FROM (SELECT event_id, ts + INTERVAL 7 HOUR AS t FROM events)""")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", text.local_time_text(F.col("ts")).alias("said"))


_TRI_SQL = "list_distinct(list_transform(range(1, greatest(length({x}) + 3 - 2, 1) + 1), lambda i: substr('  ' || {x} || ' ', i, 3)))"


@query(f"""WITH p AS (SELECT p_partkey, {_TRI_SQL.format(x="trim(regexp_replace(lower(p_name), '[ ]+', ' ', 'g'))")} AS a, {_TRI_SQL.format(x="'smal rng'")} AS b FROM part),
s AS (SELECT p_partkey, len(list_intersect(a, b)) AS n, len(list_distinct(list_concat(a, b))) AS m FROM p) SELECT p_partkey, n / m AS similarity FROM s WHERE n / m >= 0.3""")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that resemble a mistyped word, by the stored index."""
    path = f"{checkpoint_dir(spark)}/names-{uuid.uuid4().hex}"
    names.store(read_table(spark, sf_dir, "part"), path, "p_partkey", "p_name", 4)
    return names.search(spark, path, "smal rng", 0.3, 4).withColumnRenamed("key", "p_partkey")


@query(f"""WITH p AS (SELECT p_partkey, {_TRI_SQL.format(x="trim(regexp_replace(lower(p_name), '[ ]+', ' ', 'g'))")} AS a FROM part), w AS (SELECT DISTINCT p_type AS word, {_TRI_SQL.format(x="trim(regexp_replace(lower(p_type), '[ ]+', ' ', 'g'))")} AS b FROM part),
s AS (SELECT word, p_partkey, len(list_intersect(a, b)) AS n, len(list_distinct(list_concat(a, b))) AS m FROM p, w) SELECT word, p_partkey, n / m AS similarity FROM s WHERE n / m >= 0.2""")
def name_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts that resemble the name of a type of parts."""
    path = f"{checkpoint_dir(spark)}/names-{uuid.uuid4().hex}"
    part = read_table(spark, sf_dir, "part")
    names.store(part, path, "p_partkey", "p_name", 4)
    return names.search_many(spark, path, part, 0.2, "p_type").withColumnRenamed("key", "p_partkey")


@query("SELECT event_type AS connector, count(*) AS objects, CAST(sum(strlen(props)) AS BIGINT) AS bytes, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1")
def archive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = detections(spark, sf_dir)
    return h.groupBy(F.col("event_type").alias("connector")).agg(F.count(F.lit(1)).alias("objects"), F.sum(F.octet_length("props")).alias("bytes"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("SELECT count(*) AS n, epoch_us(min(ts)) AS oldest_us FROM events WHERE event_type = 'error'")
def outbox_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).filter("event_type = 'error'").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("oldest_us"))


@query("""WITH p(event_type, days) AS (VALUES ('click', 14), ('view', 8), ('error', 20)), b AS (SELECT event_id FROM events WHERE event_id % 3 <> 0)
SELECT event_id FROM events JOIN p USING (event_type) WHERE ts < TIMESTAMP '2024-01-30' - days * INTERVAL 1 DAY AND event_id IN (SELECT event_id FROM b)""")
def retention_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects past their connector's days, only if backed up."""
    e = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("connector"), F.col("event_id").alias("key"), F.col("ts").alias("fetched_at"))
    policy = spark.createDataFrame([("click", 14), ("view", 8), ("error", 20)], "connector string, days int")
    return tabular.prunable(e, e.filter("key % 3 <> 0"), policy, F.lit("2024-01-30").cast("date")).select(F.col("key").alias("event_id"))


@query(f"""WITH {EVENTS_SQL} SELECT id FROM (SELECT id, props, lag(props) OVER (PARTITION BY user_id ORDER BY us, id) AS p FROM h) WHERE p IS DISTINCT FROM props""")
def replay_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads whose content differs from their connector's payload before."""
    h = detections(spark, sf_dir).select(F.col("user_id").alias("connector"), F.col("us").alias("fetched_at"), F.col("id").alias("key"), F.col("props").alias("digest"))
    return series.changed_payloads(h).select(F.col("key").alias("id"))


_RECORDS_SQL = "r AS (SELECT event_type AS connector, epoch_us(ts) // 86400000000 AS poll, user_id AS key, CAST(floor(max(value) / 100) AS BIGINT) AS digest FROM events GROUP BY ALL)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = detections(spark, sf_dir)
    return h.groupBy(F.col("event_type").alias("connector"), F.floor(F.col("us") / 86_400_000_000).alias("poll"), F.col("user_id").alias("key")).agg(F.floor(F.max("value") / 100).alias("digest"))


@query(f"""WITH {_RECORDS_SQL}, p AS (SELECT connector, poll, lag(poll) OVER (PARTITION BY connector ORDER BY poll) AS before FROM (SELECT DISTINCT connector, poll FROM r))
SELECT r.connector, r.poll, r.key FROM r JOIN p USING (connector, poll) LEFT JOIN r o ON o.connector = r.connector AND o.poll = p.before AND o.key = r.key WHERE o.digest IS DISTINCT FROM r.digest""")
def poll_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of whole daily feeds: keys that left a feed are forgotten."""
    return series.changed_records(_records(spark, sf_dir), partial=False).select("connector", "poll", "key")


@query(f"""WITH {_RECORDS_SQL} SELECT connector, poll, key FROM (SELECT *, lag(digest) OVER (PARTITION BY connector, key ORDER BY poll) AS d FROM r) WHERE d IS DISTINCT FROM digest""")
def partial_poll_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of partial feeds: every key is remembered."""
    return series.changed_records(_records(spark, sf_dir), partial=True).select("connector", "poll", "key")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3)")
def stale_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored keys that a source no longer has; the source is the customers of three world regions."""
    c = read_table(spark, sf_dir, "customer").join(F.broadcast(read_table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # a fixed 25 rows
    return regions.stale(read_table(spark, sf_dir, "supplier"), c.filter("n_regionkey < 3").select(F.col("c_custkey").alias("s_suppkey")), "s_suppkey").select("s_suppkey")


@query("""SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 ELSE 1 END AS level FROM orders""")
def severity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.substring("o_orderpriority", 1, 1)
    name = F.when(p == "1", "Extreme").when(p == "2", "Severe").when(p == "3", "Moderate").otherwise("Minor")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", severity_level(name).alias("level"))


@query("""SELECT l_orderkey, l_linenumber, NOT (coalesce(CAST(l_discount AS FLOAT) <= CAST(l_tax AS FLOAT), true) AND coalesce(CAST(l_tax AS FLOAT) <= CAST(l_quantity AS FLOAT), true) AND coalesce(CAST(l_discount AS FLOAT) <= CAST(l_quantity AS FLOAT), true)) AS disordered FROM lineitem""")
def ensemble_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").withColumn("_n", F.lit(None).cast("double"))
    return li.select("l_orderkey", "l_linenumber", quality.ensemble_disordered("l_discount", "_n", "l_tax", "_n", "l_quantity", "_n").alias("disordered"))


@query("""WITH s AS (SELECT *, ['pm25', 'no2', 'co'][1 + event_id % 3] AS parameter, ['µg/m³', 'ppm'][1 + event_id % 2] AS unit FROM events)
SELECT event_id FROM s WHERE value <= CASE parameter || '|' || unit WHEN 'pm25|µg/m³' THEN 5000 WHEN 'no2|µg/m³' THEN 5000 WHEN 'no2|ppm' THEN 2.7 WHEN 'co|µg/m³' THEN 200000 WHEN 'co|ppm' THEN 175 END AND value >= 0""")
def unit_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (1 + F.col("event_id") % n).cast("int"))
    return e.filter(quality.within_unit_limit(pick(["pm25", "no2", "co"], 3), pick(["µg/m³", "ppm"], 2), F.col("value"))).select("event_id")


@query(f"""WITH {_SQUARES_SQL}, v AS (SELECT unnest([s, s + size]) AS y, w, size FROM q), u AS (SELECT y, unnest([w, w + size]) AS x FROM v)
SELECT DISTINCT floor(y / 0.25 + 0.5) * 0.25 AS lat, floor(x / 0.25 + 0.5) * 0.25 AS lon FROM u""")
def grid_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.grid_nodes(_squares(spark, sf_dir), 0.25)


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT day FROM d ORDER BY day DESC LIMIT 7) SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT day FROM t)""")
def newest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the newest seven days; the seven are the feature."""
    o = read_table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return o.join(o.select("day").distinct().orderBy(F.desc("day")).limit(7), "day", "left_semi").select("o_orderkey")
