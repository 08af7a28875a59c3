"""Rule-based project scoring: energy, transit, walkability, land, compliance summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.matching import band_points

# ---- fixed values: score bands -------------------------------------------------------------------
BASELINE_EUI = 150.0
ENERGY_BANDS = [
    (0.05, 6), (0.10, 7), (0.15, 8), (0.20, 9), (0.25, 10), (0.30, 11), (0.35, 12), (0.40, 13),
    (0.45, 14), (0.50, 15), (0.55, 16), (0.60, 17), (0.65, 18), (0.70, 19), (0.75, 20),
]
TRANSIT_BANDS = [(360, 216, 5), (250, 160, 4), (144, 108, 3), (100, 70, 2), (72, 30, 1)]
WALK_BANDS = [(90, 5), (80, 4), (70, 3), (60, 2), (50, 1)]
LEVELS = [(80, "Platinum"), (60, "Gold"), (50, "Silver")]
ENERGY_ADVICE = [
    (6, "Implement energy efficiency measures to achieve at least 5% improvement"),
    (10, "Consider high-performance glazing and improved insulation"),
    (15, "Evaluate HVAC system optimization and renewable energy integration"),
]
ENERGY_CREDIT = "EA_Credit_Optimize_Energy_Performance"
TRANSIT_CREDIT = "LT_Credit_Access_to_Quality_Transit"
WALK_CREDIT = "LT_Credit_Surrounding_Density_and_Diverse_Uses"
LAND_CREDIT = "SS_Credit_Sensitive_Land_Protection"
# --------------------------------------------------------------------------------------------------


def status(points: Column, unit: str = "points") -> Column:
    return F.when(points > 0, F.concat(F.lit("Achieved ("), points.cast("string"), F.lit(f" {unit})"))).otherwise("Not Achieved")


def energy_scores(projects: DataFrame, energy_scale: float = 1000.0, baseline: float = BASELINE_EUI) -> DataFrame:
    """projects(project_id, total_site_energy, building_area) -> use intensity, improvement, points, advice.

    Without an area nothing can be computed and no points are given.
    """
    eui = F.when(F.col("building_area") > 0, F.col("total_site_energy") * energy_scale / F.col("building_area"))
    scored = projects.withColumn("eui", eui).withColumn("improvement", (F.lit(baseline) - F.col("eui")) / baseline)
    points = F.when(F.col("improvement").isNotNull(), band_points(F.col("improvement"), ENERGY_BANDS)).otherwise(F.lit(0))
    out = scored.withColumn("points", points)
    advice = F.when(
        F.col("eui").isNotNull(),
        F.array_compact(F.array(*[F.when(F.col("points") < p, F.lit(t)) for p, t in ENERGY_ADVICE])),
    ).otherwise(F.array().cast("array<string>"))
    return out.withColumns(
        {
            "eui": F.coalesce("eui", F.lit(0.0)), "improvement": F.coalesce("improvement", F.lit(0.0)),
            "status": status(F.col("points")), "recommendations": advice,
        }
    )


def transit_totals(stops: DataFrame, site: str = "site_id") -> DataFrame:
    """stops(site_id, frequency, weekend_service) -> trips per site."""
    return stops.groupBy(site).agg(
        F.count(F.lit(1)).alias("n_stops"), F.coalesce(F.sum("frequency"), F.lit(0)).alias("total_trips"),
        F.coalesce(F.sum(F.when(F.col("weekend_service"), F.col("frequency"))), F.lit(0)).alias("weekend_trips"),
    )


def transit_points(total: Column, weekend: Column) -> Column:
    return F.greatest(
        *[F.when((total >= t) & (weekend >= w), F.lit(p)).otherwise(F.lit(0)) for t, w, p in TRANSIT_BANDS]
    )


def walk_points(score: Column) -> Column:
    return band_points(score, WALK_BANDS)


def diverse_uses(uses: DataFrame, site: str = "site_id") -> DataFrame:
    """uses(site_id, use): rows and distinct kinds per site."""
    return uses.groupBy(site).agg(F.count("use").alias("n_uses"), F.count_distinct("use").alias("n_kinds"))


def land_points(flood: Column, habitat: Column, farmland: Column) -> Column:
    any_flag = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in (flood, habitat, farmland)])
    return F.when(~any_flag, 1).otherwise(0)


def high_priority(income: Column, poverty: Column, unemployment: Column) -> Column:
    zero = F.lit(0)
    return (
        (F.coalesce(income, zero) <= 65000) | (F.coalesce(poverty, zero) >= 0.20) | (F.coalesce(unemployment, zero) >= 0.12)
    )


def certification_level(score: Column) -> Column:
    out = F.when(score >= LEVELS[0][0], LEVELS[0][1])
    for low, name in LEVELS[1:]:
        out = out.when(score >= low, name)
    return out.otherwise("Certified")


def projection(size: Column, score: Column) -> Column:
    """Calculator estimate: gained points, saved hours, readiness and level."""
    gain = F.least(F.lit(25), F.floor(size / 2000) + F.floor(score / 10)).cast("int")
    return F.struct(
        gain.alias("increase"), (F.floor(size / 1000) * 5).cast("int").alias("hours_saved"),
        F.least(F.lit(95), score + gain).cast("int").alias("readiness"), (score + gain).cast("int").alias("new_score"),
        certification_level(score + gain).alias("level"),
    )


def location_scores(sites: DataFrame) -> DataFrame:
    """Long score rows (project_id, credit, points, status) from total_trips, weekend_trips, walk_score and land flags."""
    g = F.col
    cards = [
        (TRANSIT_CREDIT, transit_points(g("total_trips"), g("weekend_trips")), "points"),
        (WALK_CREDIT, walk_points(g("walk_score")), "points"),
        (LAND_CREDIT, land_points(g("flood_zone"), g("sensitive_habitat"), g("prime_farmland")), "point"),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("credit"), p.cast("int").alias("points"), status(p, unit).alias("status"))
            for n, p, unit in cards
        ]
    )
    return sites.select("project_id", F.inline(rows))


def compliance_summary(projects: DataFrame, scores: DataFrame) -> DataFrame:
    """projects(project_id, n_targets) x scores(project_id, credit, points[, score_no]) -> totals and advice per project.

    Of a credit scored several times the last score counts: the highest score_no, or without one the most points.
    """
    last = F.col("score_no") if "score_no" in scores.columns else F.col("points")
    once = scores.groupBy("project_id", "credit").agg(F.max_by("points", F.struct(last, "points")).alias("points"))
    per = once.groupBy("project_id").agg(
        F.count_if(F.col("points") > 0).alias("credits_achieved"), F.sum("points").alias("total_points"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("points") > 0, F.struct("credit", "points"))))
        ).alias("credit_details"),
    )
    out = projects.join(per, "project_id", "left").withColumns(
        {
            "credits_achieved": F.coalesce("credits_achieved", F.lit(0)),
            "total_points": F.coalesce("total_points", F.lit(0)),
        }
    )
    return out.withColumn(
        "recommendations",
        F.array_compact(
            F.array(
                F.when(F.col("total_points") < 40, F.lit("Below 40 points: the energy credits have most points left")),
                F.when(
                    F.col("credits_achieved") < F.col("n_targets"),
                    F.lit("Some target credits have no points yet"),
                ),
            )
        ),
    )


def target_credits(features: Column) -> Column:
    """Target credits of a building by words in its sustainability features."""

    def any_of(*words: str) -> Column:
        return F.exists(features, lambda f: reduce(lambda a, b: a | b, [F.contains(F.lower(f), F.lit(w)) for w in words]))

    return F.array_compact(
        F.array(
            F.lit(ENERGY_CREDIT),
            F.when(any_of("water"), F.lit("WE_Credit_Water_Use_Reduction")),
            F.when(any_of("daylight", "lighting"), F.lit("EQ_Credit_Daylight")),
            F.when(any_of("solar", "green"), F.lit("SS_Credit_Heat_Island_Reduction")),
            F.lit(TRANSIT_CREDIT),
        )
    )


def buildings_to_projects(buildings: DataFrame) -> DataFrame:
    """buildings(building_name, building_code, building_type, square_footage, sustainability_features) as projects."""
    g = F.col
    area, code = g("square_footage").cast("double"), g("building_code")
    zone = F.struct(
        F.concat(code, F.lit("_Main_Zone")).alias("name"), area.alias("area"), (area * 3.0).alias("volume"),
        F.lit(3.0).alias("height"), g("building_type").alias("type"),
    )

    def surface(suffix: str, kind: str, build: str, size: Column) -> Column:
        return F.struct(
            F.concat(code, F.lit(suffix)).alias("name"), F.lit(kind).alias("type"), F.lit(build).alias("construction"), size.alias("area")
        )

    return buildings.select(
        g("building_name").alias("project_name"), F.lit("NC").alias("project_type"), area.alias("building_area"),
        F.array(zone).alias("zones"),
        F.array(
            surface("_Exterior_Wall", "Wall", "High_Performance_Wall", area * 0.3),
            surface("_Roof", "Roof", "High_Performance_Roof", area),
        ).alias("surfaces"),
        F.struct(
            F.lit("VAV").alias("system_type"),
            F.array(
                F.struct(F.concat(code, F.lit("_AHU")).alias("name"), F.lit("AHU").alias("type"),
                         (area / 1000).alias("capacity"), F.lit(0.90).alias("efficiency"))
            ).alias("equipment"),
            F.create_map(F.lit("cooling"), F.lit(24), F.lit("heating"), F.lit(20)).alias("setpoints"),
        ).alias("hvac_system"),
        target_credits(g("sustainability_features")).alias("target_credits"),
        F.concat(g("building_type"), F.lit(" building with "), F.array_join("sustainability_features", ", ")).alias("description"),
    )


def zones_with_defaults(models: DataFrame) -> DataFrame:
    """models(model_id, zones) -> one row per zone with the default values filled in."""
    z = models.select("model_id", F.explode("zones").alias("z"))
    fill = [("name", "Zone"), ("area", 0.0), ("volume", 0.0), ("height", 3.0), ("type", "Office")]
    return z.select("model_id", *[F.coalesce(F.col(f"z.{n}"), F.lit(d)).alias(n) for n, d in fill])


def materials_with_defaults(models: DataFrame) -> DataFrame:
    """models(model_id, surfaces[].materials[]) -> one row per material with the default values filled in."""
    mats = F.flatten(F.transform("surfaces", lambda s: F.coalesce(s["materials"], F.slice(s["materials"], 1, 0))))
    m = models.select("model_id", F.explode(F.filter(mats, lambda x: x.isNotNull())).alias("m"))
    fill = [("name", "Material"), ("thickness", 0.1), ("conductivity", 0.1), ("density", 1000.0), ("specific_heat", 1000.0)]
    return m.select("model_id", *[F.coalesce(F.col(f"m.{n}"), F.lit(d)).alias(n) for n, d in fill])


def equipment_with_defaults(models: DataFrame) -> DataFrame:
    e = models.select("model_id", F.explode("equipment").alias("e"))
    fill = [("name", "Equipment"), ("type", "AHU"), ("capacity", 0.0), ("efficiency", 0.8)]
    return e.select("model_id", *[F.coalesce(F.col(f"e.{n}"), F.lit(d)).alias(n) for n, d in fill])


def schedule_hours(models: DataFrame) -> DataFrame:
    """models(model_id, schedules[{name, type, values}]) -> one row per schedule and hour; all-day 1.0 by default."""
    full_day = F.array_repeat(F.lit(1.0), 24)
    s = models.select("model_id", F.explode("schedules").alias("s"))
    return s.select(
        "model_id", F.coalesce("s.name", F.lit("Schedule")).alias("name"), F.coalesce("s.type", F.lit("Fraction")).alias("type"),
        F.posexplode(F.coalesce("s.values", full_day)).alias("hour", "value"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """results(success) -> totals and success percentage."""
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"),
        F.round(F.coalesce(F.avg(F.col("success").cast("double")) * 100, F.lit(0.0)), 6).alias("success_rate"),
    )
