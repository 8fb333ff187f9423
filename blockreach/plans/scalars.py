"""Scalar expressions, each over a whole driver table."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from blockreach.functions import geometry as G, naming as N, numeric as M, schedule as S, tags as T
from blockreach.plans import carriers as C
from blockreach.plans.registry import q6, query, r6



def pick(key: Column, *names: str | None) -> Column:
    out = F.lit(names[-1]).cast("string")
    for i, n in enumerate(names[:-1]):
        out = F.when(key % len(names) == i, F.lit(n).cast("string")).otherwise(out)
    return out


def sql_pick(key: str, *names: str | None) -> str:
    return f"CASE {key} % {len(names)} " + " ".join(f"WHEN {i} THEN {'NULL' if n is None else repr(n)}" for i, n in enumerate(names)) + " END"


def over_part(name: str, value, sql: str) -> None:
    """Register ``p_partkey -> value`` over ``part``."""

    @query(name, f"SELECT p_partkey, {sql} AS value FROM part")
    def _(spark, folder, value=value):
        return C.table(spark, folder, "part", "p_partkey", "p_size", "p_retailprice", "p_brand").select("p_partkey", value(F.col("p_partkey")).alias("value"))


ROADS = ("Residential", " primary ;path", "MOTORWAY_link;x", None, "bus_stop", "track", "living_street")
over_part("fn01_primary_tag", lambda P: T.primary_tag(pick(P, *ROADS)), f"trim(lower(split_part(coalesce({sql_pick('p_partkey', *ROADS)}, ''), ';', 1)))")

SPEEDS = ("30 mph", "50", "walk", None, "25.5 km/h", "none;40", "MPH 10", "signals")
KINDS = ("residential", "primary", "path", "alley", "service")
over_part(
    "fn02_speed_kmh", lambda P: r6(T.speed_kmh(pick(P, *SPEEDS), pick(P, *KINDS))),
    q6(f"""coalesce(TRY_CAST(nullif(regexp_extract(lower(coalesce({sql_pick('p_partkey', *SPEEDS)}, '')), '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE)
      * CASE WHEN lower({sql_pick('p_partkey', *SPEEDS)}) LIKE '%mph%' THEN 1.60934 ELSE 1.0 END,
      CASE {sql_pick('p_partkey', *KINDS)} WHEN 'residential' THEN 30.0 WHEN 'primary' THEN 65.0 WHEN 'path' THEN 10.0 WHEN 'service' THEN 20.0 END, 30.0)"""),
)
USES = ("Residential", "office;x", "retail", "quarry", "cemetery", "village_green", None, "port")
over_part(
    "fn03_landuse_group", lambda P: T.landuse_group(pick(P, *USES)),
    f"CASE p_partkey % 8 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' WHEN 2 THEN 'retail' WHEN 3 THEN 'industrial' WHEN 4 THEN 'civic' WHEN 5 THEN 'green' ELSE 'other' END",
)
BUILT = ("yes", " No ", "", None, "house", "FALSE", "none")
over_part("fn04_is_building", lambda P: T.is_building(pick(P, *BUILT)), f"trim(lower(coalesce({sql_pick('p_partkey', *BUILT)}, ''))) NOT IN ('', 'no', 'none', 'false')")

over_part("fn06_tag_value", lambda P: T.tag_value(F.concat(F.lit('"brand"=>"'), F.col("p_brand"), F.lit('","'), pick(P, "size", "length"), F.lit('"=>"'), F.col("p_size").cast("string"), F.lit('"')), "size"),
          """nullif(regexp_extract('"brand"=>"' || p_brand || '","' || CASE p_partkey % 2 WHEN 0 THEN 'size' ELSE 'length' END || '"=>"' || CAST(p_size AS VARCHAR) || '"', '"size"=>"([^"]+)"', 1), '')""")

NUMBERS = ("12.5", "-666666666", "n/a", None, "0", "-999999999", " 7 ")
over_part("fn12_census_number", lambda P: r6(M.census_number(pick(P, *NUMBERS))),
          q6(f"CASE WHEN TRY_CAST({sql_pick('p_partkey', *NUMBERS)} AS DOUBLE) NOT IN (-666666666, -999999999) THEN TRY_CAST({sql_pick('p_partkey', *NUMBERS)} AS DOUBLE) END"))
over_part("fn13_census_share", lambda P: r6(M.census_share(pick(P, *NUMBERS))),
          q6(f"CASE WHEN TRY_CAST({sql_pick('p_partkey', *NUMBERS)} AS DOUBLE) NOT IN (-666666666, -999999999) THEN TRY_CAST({sql_pick('p_partkey', *NUMBERS)} AS DOUBLE) END / 100.0"))
over_part("fn14_safe_divide", lambda P: r6(M.safe_divide(F.col("p_retailprice"), P % 7)), q6("p_retailprice / nullif(p_partkey % 7, 0)"))
over_part("fn14_safe_divide_default", lambda P: r6(M.safe_divide(F.col("p_retailprice"), P % 7, 0.0)), q6("coalesce(p_retailprice / nullif(p_partkey % 7, 0), 0.0)"))
over_part("fn16_tract_of_block", lambda P: N.tract_of(C.pad(P, 15)), "substring(lpad(CAST(p_partkey AS VARCHAR), 15, '0'), 1, 11)")
over_part("fn20_log1p", lambda P: r6(M.log1p_floor(F.col("p_retailprice") - 1000.0)), q6("ln(1 + greatest(p_retailprice - 1000.0, 0))"))
over_part("fn21_undo_log1p", lambda P: r6(M.undo_log1p(M.log1p_floor(F.col("p_retailprice"))), 4), q6("p_retailprice", 4))
over_part("fn25_clip", lambda P: r6(M.clip(F.col("p_size") / 30.0 - 0.2, 0.0, 1.0)), q6("least(greatest(p_size / 30.0 - 0.2, 0.0), 1.0)"))
STATES = ("CO", "ny", "dc", "XX", "pr")
over_part("fn24_state_fips", lambda P: N.state_fips(pick(P, *STATES)), "CASE p_partkey % 5 WHEN 0 THEN '08' WHEN 1 THEN '36' WHEN 2 THEN '11' WHEN 4 THEN '72' END")
over_part("fn23_direction", lambda P: N.direction(F.col("p_size") / 25.0 - 1.0), "CASE WHEN p_size / 25.0 - 1.0 >= 0.2 THEN 'higher feature values generally raise predictions' WHEN p_size / 25.0 - 1.0 <= -0.2 THEN 'higher feature values generally lower predictions' ELSE 'mixed or weak directional pattern' END")


@query("fn05_amenity_category", f"WITH {C.AMENITIES_SQL} SELECT p_partkey, category FROM categorised")
def _(spark, folder):
    df = C.tagged_points(spark, folder)
    return df.select("p_partkey", T.amenity_category(F.col("amenity"), F.col("shop"), T.tag_value(F.col("other_tags"), "leisure")).alias("category"))


@query("flt06_known_category", f"WITH {C.AMENITIES_SQL} SELECT p_partkey, category FROM categorised WHERE category IS NOT NULL")
def _(spark, folder):
    df = C.tagged_points(spark, folder)
    kind = T.amenity_category(F.col("amenity"), F.col("shop"), T.tag_value(F.col("other_tags"), "leisure"))
    return df.select("p_partkey", kind.alias("category")).where(F.col("category").isNotNull())


def clock() -> Column:
    return F.date_format(F.col("ts"), "HH:mm:ss")


@query("fn07_clock_minutes", f"SELECT event_id, {q6('hour(ts) * 60 + minute(ts) + second(ts) / 60.0')} AS minutes FROM events")
def _(spark, folder):
    return C.table(spark, folder, "events", "event_id", "ts").select("event_id", r6(S.clock_minutes(clock())).alias("minutes"))


@query("fn08_is_peak", "SELECT event_id, hour(ts) IN (7, 8, 16, 17) AS is_peak FROM events")
def _(spark, folder):
    return C.table(spark, folder, "events", "event_id", "ts").select("event_id", S.is_peak(S.clock_minutes(clock())).alias("is_peak"))


TYPES = ("0", "1", "2", "3", "11", "700", "900", "9999", "499", "150", "12", "bus")
over_part("fn09_route_mode", lambda P: S.route_mode(pick(P, *TYPES)),
          "CASE p_partkey % 12 WHEN 0 THEN 'tram' WHEN 1 THEN 'metro' WHEN 2 THEN 'train' WHEN 3 THEN 'bus' WHEN 4 THEN 'bus' WHEN 5 THEN 'bus' WHEN 6 THEN 'tram' WHEN 8 THEN 'metro' WHEN 9 THEN 'train' WHEN 10 THEN 'train' ELSE 'other' END")


@query("fn10_composite_keys", "SELECT c_custkey, 'feed' || CAST(c_nationkey AS VARCHAR) || ':' || CAST(c_custkey AS VARCHAR) AS feed_key, 'city_' || CAST(c_nationkey AS VARCHAR) || ':' || CAST(c_custkey AS VARCHAR) AS node_id FROM customer")
def _(spark, folder):
    df = C.table(spark, folder, "customer", "c_custkey", "c_nationkey")
    raw = F.col("c_custkey").cast("string")
    city = F.concat(F.lit("city_"), F.col("c_nationkey").cast("string"))
    return df.select("c_custkey", S.feed_key(F.col("c_nationkey"), raw).alias("feed_key"), N.node_id(city, raw).alias("node_id"))


@query("fn11_stop_place", "SELECT c_custkey, round_even(c_acctbal / 7.0, 1) + 0.0 AS px, round_even(c_acctbal / 3.0, 1) + 0.0 AS py FROM customer")
def _(spark, folder):
    df = C.table(spark, folder, "customer", "c_custkey", "c_acctbal").withColumn("p", S.stop_place(F.col("c_acctbal") / 7.0, F.col("c_acctbal") / 3.0))
    return df.select("c_custkey", (F.col("p.x") + 0.0).alias("px"), (F.col("p.y") + 0.0).alias("py"))


@query("fn15_sum_present", f"""SELECT p_partkey, {q6('CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) END')} AS total FROM (
  SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS a, CASE WHEN p_partkey % 4 > 1 THEN p_retailprice END AS b FROM part)""")
def _(spark, folder):
    P = F.col("p_partkey")
    df = C.table(spark, folder, "part", "p_partkey", "p_size", "p_retailprice").select(
        "p_partkey", F.when(P % 3 > 0, F.col("p_size")).alias("a"), F.when(P % 4 > 1, F.col("p_retailprice")).alias("b"))
    return df.select("p_partkey", r6(M.sum_present(df.columns, ["a", "b", "absent"])).alias("total"))


@query("fn22_feature_parts", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'PT' WHEN 1 THEN 'BE' WHEN 2 THEN 'ACS' ELSE 'other' END AS family,
  CASE c_custkey % 4 WHEN 0 THEN 'public transport' WHEN 1 THEN 'built environment' WHEN 2 THEN 'sociodemographic' ELSE 'other' END AS title,
  CASE c_custkey % 4 WHEN 3 THEN 'x ' ELSE '' END || 'stop ' || lower(c_mktsegment) AS label FROM customer""")
def _(spark, folder):
    key = F.col("c_custkey")
    name = F.concat(pick(key, "pt_", "be_", "acs_", "x_"), F.lit("stop_"), F.lower("c_mktsegment"))
    return C.table(spark, folder, "customer", "c_custkey", "c_mktsegment").select(
        "c_custkey", N.family_code(name).alias("family"), N.family_title(name).alias("title"), N.feature_label(name).alias("label"))


@query("flt05_positive_jobs", f"WITH {C.JOBS_SQL} SELECT s_suppkey, {q6('jobs')} AS jobs FROM jobs WHERE jobs > 0")
def _(spark, folder):
    return C.job_sites(spark, folder).where(F.col("jobs") > 0).select("s_suppkey", r6(F.col("jobs")).alias("jobs"))
