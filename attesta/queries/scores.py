"""Project score cards over the order tables: suppliers and customers stand for projects and sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.matching import keyword_lookup, match_credit, stops_near_sites, with_tracts
from ..plans.reports import compliance_reports, location_reports, project_results
from ..plans.scorecards import (
    ENERGY_CREDIT, buildings_to_projects, compliance_summary, diverse_uses, energy_scores, equipment_with_defaults,
    high_priority, land_points, location_scores, materials_with_defaults, projection, run_summary, schedule_hours,
    transit_points, transit_totals, walk_points, zones_with_defaults,
)
from ..session import table
from ..sources.readers import meter_months, site_energy
from .inputs import TOPIC_QUERIES_SQL, topic_queries
from .registry import query

ENERGY_CASE = "CASE " + " ".join(
    f"WHEN improvement >= {t / 100:.2f} THEN {p}" for t, p in sorted(((5 * (i + 1), 6 + i) for i in range(15)), reverse=True)
) + " ELSE 0 END"
TRANSIT_CASE = """CASE WHEN total_trips >= 360 AND weekend_trips >= 216 THEN 5 WHEN total_trips >= 250 AND weekend_trips >= 160 THEN 4
 WHEN total_trips >= 144 AND weekend_trips >= 108 THEN 3 WHEN total_trips >= 100 AND weekend_trips >= 70 THEN 2 WHEN total_trips >= 72 AND weekend_trips >= 30 THEN 1 ELSE 0 END"""
WALK_CASE = "CASE WHEN {v} >= 90 THEN 5 WHEN {v} >= 80 THEN 4 WHEN {v} >= 70 THEN 3 WHEN {v} >= 60 THEN 2 WHEN {v} >= 50 THEN 1 ELSE 0 END"
STATUS = "CASE WHEN points > 0 THEN 'Achieved (' || points || ' points)' ELSE 'Not Achieved' END"

# a customer is a building: area by key, energy by the quantities of its orders
ENERGY_SQL = f"""pr AS (SELECT o_custkey AS project_id, sum(l_quantity::BIGINT) AS total_site_energy FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
pa AS (SELECT *, (project_id % 13 * 1500)::DOUBLE AS building_area FROM pr),
pe AS (SELECT *, CASE WHEN building_area > 0 THEN total_site_energy * 1000.0::DOUBLE / building_area END AS e FROM pa),
pi AS (SELECT project_id, coalesce(e, 0) AS eui, coalesce((150.0::DOUBLE - e) / 150.0::DOUBLE, 0) AS improvement, e IS NULL AS no_area FROM pe),
en AS MATERIALIZED (SELECT *, CASE WHEN no_area THEN 0 ELSE {ENERGY_CASE} END AS points FROM pi)"""


def energy_projects(spark, sf):
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    # quantities are added up per order first, so the join moves one row per order
    per_order = l.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    use = per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("project_id")).agg(
        F.sum("q").alias("total_site_energy")
    )
    return use.withColumn("building_area", (F.col("project_id") % 13 * 1500).cast("double"))


@query(
    "energy_points",
    f"""WITH {ENERGY_SQL} SELECT project_id, round(eui, 6) AS eui, round(improvement, 6) AS improvement, points, {STATUS} AS status,
 CASE WHEN no_area THEN 0 ELSE (points < 6)::INT + (points < 10)::INT + (points < 15)::INT END AS n_recommendations FROM en""",
)
def energy_points(spark, sf):
    s = energy_scores(energy_projects(spark, sf))
    return s.select(
        "project_id", F.round("eui", 6).alias("eui"), F.round("improvement", 6).alias("improvement"), "points", "status",
        F.size("recommendations").alias("n_recommendations"),
    )


# a line item is a stop of the supplier's site
TRANSIT_SQL = f"""tt AS (SELECT l_suppkey AS site_id, count(*) AS n_stops, sum((l_quantity / 10)::BIGINT) AS total_trips,
  coalesce(sum((l_quantity / 10)::BIGINT) FILTER (l_returnflag = 'A'), 0) AS weekend_trips FROM lineitem GROUP BY ALL),
tp AS MATERIALIZED (SELECT *, {TRANSIT_CASE} AS points FROM tt)"""
TRANSIT_SQL = TRANSIT_SQL.replace("(l_quantity / 10)::BIGINT", "floor(l_quantity / 10)::BIGINT")


def transit_sites(spark, sf):
    stops = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("site_id"), F.floor(F.col("l_quantity") / 10).alias("frequency"),
        (F.col("l_returnflag") == "A").alias("weekend_service"),
    )
    return transit_totals(stops)


@query("transit_points", f"WITH {TRANSIT_SQL} SELECT site_id, n_stops, total_trips::BIGINT AS total_trips, weekend_trips::BIGINT AS weekend_trips, points FROM tp")
def transit_points_query(spark, sf):
    return transit_sites(spark, sf).withColumn("points", transit_points(F.col("total_trips"), F.col("weekend_trips")))


WALK_SQL = f"""wu AS (SELECT o_custkey AS site_id, count(*) AS n_uses, count(DISTINCT o_orderpriority) AS n_kinds FROM orders GROUP BY ALL),
wk AS MATERIALIZED (SELECT *, n_kinds * 20 - 5 AS walk_score, {WALK_CASE.format(v='(n_kinds * 20 - 5)')} AS points FROM wu)"""


def walk_sites(spark, sf):
    uses = table(spark, sf, "orders").select(F.col("o_custkey").alias("site_id"), F.col("o_orderpriority").alias("use"))
    return diverse_uses(uses).withColumn("walk_score", F.col("n_kinds") * 20 - 5)


@query("walk_points", f"WITH {WALK_SQL} SELECT site_id, n_uses, n_kinds, walk_score, points FROM wk")
def walk_points_query(spark, sf):
    return walk_sites(spark, sf).withColumn("points", walk_points(F.col("walk_score")))


@query(
    "land_eligibility",
    """WITH f AS (SELECT c_custkey AS site_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment = 'BUILDING' END AS flood, c_acctbal < 500 AS habitat, c_nationkey % 8 = 0 AS farmland,
  c_acctbal * 20 AS income, c_nationkey / 100.0::DOUBLE AS poverty, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 15 / 100.0::DOUBLE END AS unemployment FROM customer)
SELECT site_id, CASE WHEN coalesce(flood, false) OR habitat OR farmland THEN 0 ELSE 1 END AS points,
 income <= 65000 OR poverty >= 0.20::DOUBLE OR coalesce(unemployment, 0) >= 0.12::DOUBLE AS high_priority FROM f""",
)
def land_eligibility(spark, sf):
    c = table(spark, sf, "customer")
    flood = F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment") == "BUILDING")
    return c.select(
        F.col("c_custkey").alias("site_id"), land_points(flood, F.col("c_acctbal") < 500, F.col("c_nationkey") % 8 == 0).alias("points"),
        high_priority(
            F.col("c_acctbal") * 20, F.col("c_nationkey") / 100.0, F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 15 / 100.0)
        ).alias("high_priority"),
    )


@query(
    "tract_eligibility",
    """WITH t AS (SELECT n_nationkey AS tract, n_regionkey * 20000 + 30000 AS median_income, n_nationkey / 200.0::DOUBLE AS poverty_rate, n_nationkey / 150.0::DOUBLE AS unemployment_rate FROM nation)
SELECT s_suppkey AS site_id, coalesce(tract, -1) AS tract, coalesce(median_income, 0) <= 65000 OR coalesce(poverty_rate, 0) >= 0.20::DOUBLE OR coalesce(unemployment_rate, 0) >= 0.12::DOUBLE AS eligible FROM supplier LEFT JOIN t ON s_nationkey + s_suppkey % 3 = tract""",
)
def tract_eligibility(spark, sf):
    key = F.col("n_nationkey")
    tracts = table(spark, sf, "nation").select(
        key.alias("tract"), (F.col("n_regionkey") * 20000 + 30000).alias("median_income"), (key / 200.0).alias("poverty_rate"), (key / 150.0).alias("unemployment_rate")
    )
    sites = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site_id"), (F.col("s_nationkey") + F.col("s_suppkey") % 3).alias("tract"))
    known = F.col("median_income").isNotNull()
    return with_tracts(sites, tracts).select(
        "site_id", F.when(known, F.col("tract")).otherwise(F.lit(-1)).alias("tract"),
        high_priority(F.col("median_income"), F.col("poverty_rate"), F.col("unemployment_rate")).alias("eligible"),
    )


# customers and suppliers get places on a 0.2 degree square; every fifth shares one place
STOPS_SQL = """si AS (SELECT c_custkey AS site_id, 30.2::DOUBLE + (CASE WHEN c_custkey % 5 = 0 THEN 77 ELSE c_custkey * 37 % 1009 END) / 5000.0::DOUBLE AS lat,
   -97.8::DOUBLE + (CASE WHEN c_custkey % 5 = 0 THEN 77 ELSE c_custkey * 91 % 1013 END) / 5000.0::DOUBLE AS lon FROM customer),
so AS (SELECT 30.2::DOUBLE + (CASE WHEN s_suppkey % 5 = 0 THEN 78 ELSE s_suppkey * 53 % 1009 END) / 5000.0::DOUBLE AS slat,
   -97.8::DOUBLE + (CASE WHEN s_suppkey % 5 = 0 THEN 77 ELSE s_suppkey * 71 % 1013 END) / 5000.0::DOUBLE AS slon, s_suppkey % 40 AS frequency, s_suppkey % 3 = 0 AS weekend FROM supplier),
nr AS (SELECT site_id, frequency, weekend FROM si JOIN so ON 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(slat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2)))) <= 800),
na AS (SELECT site_id, count(*) AS n_stops, sum(frequency) AS total_trips, sum(CASE WHEN weekend THEN frequency ELSE 0 END) AS weekend_trips FROM nr GROUP BY ALL)"""


def _places(df, key, hot_y, fy, fx):
    k = F.col(key)
    y = F.when(k % 5 == 0, F.lit(hot_y)).otherwise(k * fy % 1009)
    x = F.when(k % 5 == 0, F.lit(77)).otherwise(k * fx % 1013)
    return df.select((F.lit(30.2) + y / 5000.0).alias("lat"), (F.lit(-97.8) + x / 5000.0).alias("lon"), k.alias("k"))


@query(
    "stops_near_sites",
    f"""WITH {STOPS_SQL} SELECT site_id, coalesce(n_stops, 0)::BIGINT AS n_stops, coalesce(total_trips, 0)::BIGINT AS total_trips, coalesce(weekend_trips, 0)::BIGINT AS weekend_trips FROM si LEFT JOIN na USING (site_id)""",
)
def stops_near_sites_query(spark, sf):
    sites = _places(table(spark, sf, "customer"), "c_custkey", 77, 37, 91).withColumnRenamed("k", "site_id")
    stops = _places(table(spark, sf, "supplier"), "s_suppkey", 78, 53, 71).select(
        "lat", "lon", (F.col("k") % 40).alias("frequency"), (F.col("k") % 3 == 0).alias("weekend")
    )
    return stops_near_sites(sites, stops, 800.0)


LOCATION_SQL = f"""{TRANSIT_SQL}, ss AS (SELECT s_suppkey AS project_id, coalesce(tp.total_trips, 0) AS total_trips, coalesce(tp.weekend_trips, 0) AS weekend_trips, (s_suppkey * 7 % 60 + 40) AS walk_score, s_suppkey % 5 = 0 AS flood,
   s_suppkey % 7 = 0 AS habitat, coalesce(tp.points, 0) AS tpts FROM supplier LEFT JOIN tp ON site_id = s_suppkey),
loc AS MATERIALIZED (SELECT project_id, 'LT_Credit_Access_to_Quality_Transit' AS credit, tpts AS points, CASE WHEN tpts > 0 THEN 'Achieved (' || tpts || ' points)' ELSE 'Not Achieved' END AS status FROM ss
 UNION ALL SELECT project_id, 'LT_Credit_Surrounding_Density_and_Diverse_Uses', {WALK_CASE.format(v='walk_score')}, CASE WHEN walk_score >= 50 THEN 'Achieved (' || ({WALK_CASE.format(v='walk_score')}) || ' points)' ELSE 'Not Achieved' END FROM ss
 UNION ALL SELECT project_id, 'SS_Credit_Sensitive_Land_Protection', CASE WHEN flood OR habitat THEN 0 ELSE 1 END, CASE WHEN flood OR habitat THEN 'Not Achieved' ELSE 'Achieved (1 point)' END FROM ss)"""


def location_sites(spark, sf):
    k = F.col("s_suppkey")
    sites = table(spark, sf, "supplier").select(k.alias("project_id"), "s_name").join(
        transit_sites(spark, sf).withColumnRenamed("site_id", "project_id"), "project_id", "left"
    )
    p = F.col("project_id")
    return sites.select(
        "project_id", F.col("s_name").alias("address"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_stops", "total_trips", "weekend_trips")],
        (p * 7 % 60 + 40).alias("walk_score"), (p % 5 == 0).alias("flood_zone"), (p % 7 == 0).alias("sensitive_habitat"),
        F.lit(None).cast("boolean").alias("prime_farmland"),
    )


@query("location_scores", f"WITH {LOCATION_SQL} SELECT project_id, credit, points, status FROM loc")
def location_scores_query(spark, sf):
    return location_scores(location_sites(spark, sf))


SUMMARY_SQL = f"""{LOCATION_SQL}, en0 AS (SELECT l_suppkey AS project_id, sum(l_quantity::BIGINT) AS e, (l_suppkey % 11 * 90000 + 1000)::DOUBLE AS a FROM lineitem GROUP BY ALL),
en1 AS (SELECT project_id, (150.0::DOUBLE - e * 1000.0::DOUBLE / a) / 150.0::DOUBLE AS improvement FROM en0),
alls AS (SELECT project_id, credit, points FROM loc UNION ALL SELECT project_id, 'EA_Credit_Optimize_Energy_Performance', {ENERGY_CASE} FROM en1),
sm AS (SELECT project_id, count(*) FILTER (points > 0) AS credits_achieved, sum(points)::BIGINT AS total_points, string_agg(CASE WHEN points > 0 THEN credit || '=' || points END, ', ' ORDER BY credit) AS details FROM alls GROUP BY ALL),
sn AS MATERIALIZED (SELECT s_suppkey AS project_id, s_name, s_suppkey % 3 + 2 AS n_targets, coalesce(credits_achieved, 0) AS credits_achieved, coalesce(total_points, 0) AS total_points, coalesce(details, '') AS details FROM supplier LEFT JOIN sm ON sm.project_id = s_suppkey)"""


def supplier_energy(spark, sf):
    use = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("project_id")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("total_site_energy")
    )
    return energy_scores(use.withColumn("building_area", (F.col("project_id") % 11 * 90000 + 1000).cast("double")))


def supplier_summary(spark, sf):
    energy = supplier_energy(spark, sf).select("project_id", F.lit(ENERGY_CREDIT).alias("credit"), "points", "status")
    scores = location_scores(location_sites(spark, sf)).unionByName(energy)
    projects = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("project_id"), F.col("s_name").alias("project_name"), (F.col("s_suppkey") % 3 + 2).alias("n_targets")
    )
    return compliance_summary(projects, scores)


@query(
    "compliance_summary",
    f"""WITH {SUMMARY_SQL} SELECT project_id, n_targets, credits_achieved, total_points, details, concat_ws(' ~ ', CASE WHEN total_points < 40 THEN 'Below 40 points: the energy credits have most points left' END,
 CASE WHEN credits_achieved < n_targets THEN 'Some target credits have no points yet' END) AS recommendations FROM sn""",
)
def compliance_summary_query(spark, sf):
    s = supplier_summary(spark, sf)
    details = F.array_join(
        F.transform(F.map_entries("credit_details"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", "
    )
    return s.select(
        "project_id", "n_targets", "credits_achieved", "total_points", F.coalesce(details, F.lit("")).alias("details"),
        F.array_join("recommendations", " ~ ").alias("recommendations"),
    )


@query(
    "compliance_reports",
    f"""WITH {SUMMARY_SQL}, r AS (SELECT *, concat_ws(chr(10), CASE WHEN total_points < 40 THEN '- Below 40 points: the energy credits have most points left' END,
 CASE WHEN credits_achieved < n_targets THEN '- Some target credits have no points yet' END) AS recs FROM sn)
SELECT project_id, '# LEED Certification Analysis Report' || chr(10) || chr(10) || '**Project:** ' || s_name || chr(10) || chr(10) || '## Compliance Summary' || chr(10)
 || '- Total Credits Analyzed: ' || n_targets || chr(10) || '- Credits Achieved: ' || credits_achieved || chr(10) || '- Total Points: ' || total_points || chr(10)
 || CASE WHEN details <> '' THEN chr(10) || '### Credit Details' || chr(10) || regexp_replace(replace(details, ', ', chr(10)), '([A-Za-z_]+)=(\\d+)', '- **\\1**: \\2 points', 'g') || chr(10) ELSE '' END
 || CASE WHEN recs <> '' THEN chr(10) || '### Recommendations' || chr(10) || recs || chr(10) ELSE '' END AS report FROM r""",
)
def compliance_reports_query(spark, sf):
    return compliance_reports(supplier_summary(spark, sf))


@query(
    "location_reports",
    f"""WITH {LOCATION_SQL}, j AS (SELECT project_id, string_agg('### ' || credit || chr(10) || '- Status: ' || status || chr(10) || '- Points: ' || points, chr(10) || chr(10) ORDER BY credit) AS cards,
   max(CASE WHEN credit LIKE 'LT_Credit_A%' THEN points END) AS t, max(CASE WHEN credit LIKE 'LT_Credit_S%' THEN points END) AS w, max(CASE WHEN credit LIKE 'SS%' THEN points END) AS l FROM loc GROUP BY ALL)
SELECT ss.project_id, '# Location Analysis Report' || chr(10) || chr(10) || '## Site Information' || chr(10) || '- Address: ' || s_name || chr(10) || chr(10) || '## Transit Access Analysis' || chr(10)
 || '- Total weekday trips: ' || ss.total_trips || chr(10) || '- Weekend trips: ' || ss.weekend_trips || chr(10) || '- Nearby stops: ' || coalesce(n_stops, 0) || chr(10) || '- LT Credit Points: ' || t || chr(10) || chr(10)
 || '## Walkability Analysis' || chr(10) || '- Walk Score: ' || walk_score || chr(10) || '- LT Credit Points: ' || w || chr(10) || chr(10)
 || '## Environmental Context' || chr(10) || '- Flood zone: ' || flood || chr(10) || '- Sensitive habitat: ' || habitat || chr(10) || '- Prime farmland: false' || chr(10) || '- SS Credit Points: ' || l || chr(10) || chr(10)
 || '## LEED Credit Summary' || chr(10) || cards AS report FROM ss JOIN j USING (project_id) JOIN supplier ON s_suppkey = ss.project_id LEFT JOIN tp ON site_id = ss.project_id""",
)
def location_reports_query(spark, sf):
    return location_reports(location_sites(spark, sf))


@query(
    "project_results",
    f"""WITH {SUMMARY_SQL} SELECT project_id, '{{"project_id":' || project_id || ',"project_name":"' || s_name || '","summary":{{"total_credits_analyzed":' || n_targets || ',"credits_achieved":' || credits_achieved || ',"total_points":' || total_points || '}}}}' AS result FROM sn""",
)
def project_results_query(spark, sf):
    return project_results(supplier_summary(spark, sf)).select("project_id", F.to_json(F.struct("project_id", "project_name", "summary")).alias("result"))


@query(
    "score_projection",
    """WITH p AS (SELECT p_partkey, p_size * 800 + p_partkey % 700 AS size, p_size + 30 AS score FROM part),
g AS (SELECT *, least(25, size // 2000 + score // 10) AS increase FROM p)
SELECT p_partkey, increase::INT AS increase, (size // 1000 * 5)::INT AS hours_saved, least(95, score + increase)::INT AS readiness, (score + increase)::INT AS new_score,
 CASE WHEN score + increase >= 80 THEN 'Platinum' WHEN score + increase >= 60 THEN 'Gold' WHEN score + increase >= 50 THEN 'Silver' ELSE 'Certified' END AS level FROM g""",
)
def score_projection(spark, sf):
    p = projection(F.col("p_size") * 800 + F.col("p_partkey") % 700, F.col("p_size") + 30)
    return table(spark, sf, "part").select("p_partkey", p.alias("p")).select("p_partkey", "p.*")


FEATURES_CASE = "CASE p_size % 5 WHEN 0 THEN ['Rain Water tanks'] WHEN 1 THEN ['LED Lighting', 'Solar panels'] WHEN 2 THEN ['green roof'] WHEN 3 THEN ['daylight', 'low water'] ELSE ['none'] END"
BUILDING_SQL = f"""bl AS (SELECT p_partkey, p_name || ' Hall' AS project_name, p_brand AS code, p_type, (p_size * 1000)::BIGINT AS area, {FEATURES_CASE} AS f FROM part)"""


def part_buildings(spark, sf):
    s = F.col("p_size") % 5
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    features = (
        F.when(s == 0, lit("Rain Water tanks")).when(s == 1, lit("LED Lighting", "Solar panels")).when(s == 2, lit("green roof"))
        .when(s == 3, lit("daylight", "low water")).otherwise(lit("none"))
    )
    return table(spark, sf, "part").select(
        F.concat("p_name", F.lit(" Hall")).alias("building_name"), F.col("p_brand").alias("building_code"), F.col("p_type").alias("building_type"),
        (F.col("p_size") * 1000).cast("long").alias("square_footage"), features.alias("sustainability_features"), "p_size",
    )


@query(
    "building_projects",
    f"""WITH {BUILDING_SQL} SELECT project_name, code || '_Main_Zone' AS zone, area * 3.0::DOUBLE AS volume, round(area * 0.3::DOUBLE, 6) AS wall_area, area / 1000.0::DOUBLE AS capacity,
 concat_ws(',', 'EA_Credit_Optimize_Energy_Performance', CASE WHEN list_has_any(f, ['Rain Water tanks', 'low water']) THEN 'WE_Credit_Water_Use_Reduction' END,
  CASE WHEN list_has_any(f, ['LED Lighting', 'daylight']) THEN 'EQ_Credit_Daylight' END, CASE WHEN list_has_any(f, ['Solar panels', 'green roof']) THEN 'SS_Credit_Heat_Island_Reduction' END,
  'LT_Credit_Access_to_Quality_Transit') AS target_credits, p_type || ' building with ' || array_to_string(f, ', ') AS description FROM bl""",
)
def building_projects(spark, sf):
    p = buildings_to_projects(part_buildings(spark, sf))
    return p.select(
        "project_name", F.get("zones", F.lit(0))["name"].alias("zone"), F.get("zones", F.lit(0))["volume"].alias("volume"),
        F.round(F.get("surfaces", F.lit(0))["area"], 6).alias("wall_area"), F.get("hvac_system.equipment", F.lit(0))["capacity"].alias("capacity"),
        F.array_join("target_credits", ",").alias("target_credits"), "description",
    )


@query(
    "building_run_summary",
    f"WITH {BUILDING_SQL}, r AS (SELECT area >= 10000 AND len(f) = 1 AS success FROM bl) SELECT count(*) AS total, count(*) FILTER (success) AS successful, round(avg(success::INT::DOUBLE) * 100, 6) AS success_rate FROM r",
)
def building_run_summary(spark, sf):
    b = part_buildings(spark, sf)
    return run_summary(b.select(((F.col("square_footage") >= 10000) & (F.size("sustainability_features") == 1)).alias("success")))


@query(
    "model_defaults",
    """WITH z AS (SELECT p_partkey AS model_id, CASE WHEN p_size % 2 = 0 THEN p_name END AS name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size::DOUBLE END AS v FROM part)
SELECT model_id, 'zone' AS kind, coalesce(name, 'Zone') AS name, coalesce(v, 3.0::DOUBLE) AS a, 0.0::DOUBLE AS b FROM z
UNION ALL SELECT model_id, 'material', coalesce(name, 'Material'), coalesce(v, 0.1::DOUBLE), 1000.0 FROM z WHERE model_id % 4 <> 0
UNION ALL SELECT model_id, 'equipment', coalesce(name, 'Equipment'), coalesce(v, 0.0), 0.8 FROM z
UNION ALL SELECT model_id, 'schedule', 'Schedule', sum(CASE WHEN model_id % 5 = 0 THEN 1.0 ELSE h % 2 END)::DOUBLE, count(*)::DOUBLE FROM z, generate_series(0, 23) t(h) GROUP BY ALL""",
)
def model_defaults(spark, sf):
    name, v = F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("double"))
    dn, tn = F.lit(None).cast("double"), F.lit(None).cast("string")
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: (h % 2).cast("double"))
    material = F.struct(name.alias("name"), v.alias("thickness"), dn.alias("conductivity"), dn.alias("density"), dn.alias("specific_heat"))
    m = table(spark, sf, "part").select(
        F.col("p_partkey").alias("model_id"),
        F.array(F.struct(name.alias("name"), dn.alias("area"), dn.alias("volume"), v.alias("height"), tn.alias("type"))).alias("zones"),
        F.array(F.struct(F.when(F.col("p_partkey") % 4 != 0, F.array(material)).alias("materials"))).alias("surfaces"),
        F.array(F.struct(name.alias("name"), tn.alias("type"), v.alias("capacity"), dn.alias("efficiency"))).alias("equipment"),
        F.array(F.struct(tn.alias("name"), tn.alias("type"), F.when(F.col("p_partkey") % 5 != 0, hours).alias("values"))).alias("schedules"),
    )
    pick = lambda df, kind, a, b: df.select("model_id", F.lit(kind).alias("kind"), "name", F.col(a).alias("a"), F.col(b).alias("b"))
    hourly = schedule_hours(m).groupBy("model_id", "name").agg(F.sum("value").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    return (
        pick(zones_with_defaults(m), "zone", "height", "area")
        .unionByName(pick(materials_with_defaults(m), "material", "thickness", "density"))
        .unionByName(pick(equipment_with_defaults(m), "equipment", "capacity", "efficiency"))
        .unionByName(pick(hourly, "schedule", "s", "n"))
    )


@query(
    "meter_months",
    """WITH m AS (SELECT c_custkey, month(o_orderdate) AS mo, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
c AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders)),
g AS (SELECT c_custkey, c_name, unnest(generate_series(1, 12)) AS mo FROM c),
v AS (SELECT c_name AS meter, mo, n FROM g JOIN m USING (c_custkey, mo))
SELECT meter, (row_number() OVER (PARTITION BY meter ORDER BY mo))::INT AS month, n::DOUBLE AS value FROM v""",
)
def meter_months_query(spark, sf):
    """Orders per month as meter lines 'name,m1,…,m12'; empty months are blank, some lines are too short."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    months = [F.count(F.when(F.month("o_orderdate") == m, 1)).alias(f"m{m}") for m in range(1, 13)]
    per = o.groupBy("o_custkey").agg(*months)
    blank = [F.when(F.col(f"m{m}") > 0, F.col(f"m{m}").cast("string")).otherwise("") for m in range(1, 13)]
    full = F.array(F.col("c_name"), *blank)
    values = F.when(F.col("c_custkey") % 10 == 0, F.slice(full, 1, 12)).otherwise(full)
    lines = per.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.array_join(values, ",").alias("line"))
    return meter_months(lines.select(F.split("line", ",").alias("parts")), [], "parts")


@query(
    "site_energy",
    """SELECT o_custkey, max(o_orderkey) FILTER (o_orderkey % 3 = 0)::DOUBLE AS total_site_energy, max(o_orderkey) FILTER (o_orderkey % 3 = 1)::DOUBLE AS total_source_energy FROM orders
GROUP BY ALL""",
)
def site_energy_query(spark, sf):
    key = F.col("o_orderkey")
    label = F.when(key % 3 == 0, "Total Site Energy").when(key % 3 == 1, "Total Source Energy").otherwise("Other")
    lines = table(spark, sf, "orders").select("o_custkey", key.alias("line_no"), F.concat_ws(",", label, key.cast("string"), F.lit("kBtu")).alias("line"))
    return site_energy(lines, ["o_custkey"])


@query(
    "keyword_fallback",
    f"""WITH {TOPIC_QUERIES_SQL}, kt AS (SELECT r_name AS title, ['energy', 'water', 'materials', 'indoor', 'general'][r_regionkey + 1] AS keyword, r_regionkey AS pos FROM region),
h AS (SELECT query_id, keyword, title FROM q JOIN kt ON contains(lower(text), keyword) AND keyword <> 'general')
SELECT * FROM h UNION ALL SELECT query_id, keyword, title FROM q, kt WHERE keyword = 'general' AND query_id NOT IN (SELECT query_id FROM h)""",
)
def keyword_fallback(spark, sf):
    words = F.array(*[F.lit(w) for w in ("energy", "water", "materials", "indoor", "general")])
    t = table(spark, sf, "region").select(
        F.get(words, F.col("r_regionkey")).alias("keyword"), F.col("r_regionkey").alias("pos"), F.col("r_name").alias("title")
    )
    return keyword_lookup(topic_queries(spark, sf), t, "general").select("query_id", "keyword", "title")


@query(
    "credit_match",
    """WITH t AS (SELECT c_custkey AS target_id, CASE c_custkey % 3 WHEN 0 THEN 'Brand#' || (c_custkey % 30) WHEN 1 THEN upper(substr(c_mktsegment, 1, 3)) ELSE ['ring', 'RED', 'olt', 'xx'][c_custkey % 4 + 1] END AS target FROM customer),
m AS (SELECT target_id, p_partkey, p_brand, p_name FROM t JOIN part ON p_brand = target OR contains(lower(p_name), lower(target)) QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY p_partkey) = 1)
SELECT target_id, target, coalesce(p_brand, '-') AS code, coalesce(p_name, '-') AS name FROM t LEFT JOIN m USING (target_id)""",
)
def credit_match(spark, sf):
    k = F.col("c_custkey")
    words = F.array(*[F.lit(w) for w in ("ring", "RED", "olt", "xx")])
    target = (
        F.when(k % 3 == 0, F.concat(F.lit("Brand#"), (k % 30).cast("string")))
        .when(k % 3 == 1, F.upper(F.substring("c_mktsegment", 1, 3))).otherwise(F.get(words, (k % 4).cast("int")))
    )
    targets = table(spark, sf, "customer").select(k.alias("target_id"), target.alias("target"))
    catalogue = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("code"), F.col("p_name").alias("name"))
    dash = F.lit("-")
    return match_credit(targets, catalogue).select("target_id", "target", F.coalesce("code", dash).alias("code"), F.coalesce("name", dash).alias("name"))
