"""Joins by containment, nearest name, bands and distance, written as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import value_counts
from .skew import join_to_unique

GRAM = 3
EARTH_RADIUS_M = 6_371_000.0


def grams(text: Column, n: int) -> Column:
    """All strings of `n` characters in the text, each once; none if it is shorter."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda p: F.substr(text, p, F.lit(n))))


def contained_candidates(hay: DataFrame, hay_id: str, needles: DataFrame) -> DataFrame:
    """Pairs (hay_id, _needle) that share the needle's rarest piece. hay(hay_id, _low), needles(_needle): lower case.

    A needle is filed under one piece of GRAM characters, the one that the fewest texts have (a shorter
    needle under itself); a needle with a piece that no text has is out. Texts are looked up under their own
    pieces, so pairs follow the rarest pieces, not the texts' lengths.
    """
    size = F.least(F.length("_needle"), F.lit(GRAM))
    pieces = needles.select("_needle", size.alias("_n")).distinct()
    filed = pieces.select("_needle", F.explode(F.when(F.col("_n") == GRAM, grams(F.col("_needle"), GRAM)).otherwise(F.array("_needle"))).alias("_gram"))
    lengths = pieces.agg(F.collect_set("_n")).scalar()  # GRAM different ones at most
    held = hay.select(hay_id, "_low", lengths.alias("_lengths"))
    own = F.flatten(F.transform("_lengths", lambda n: _grams_of(F.col("_low"), n)))
    # pieces of no needle leave before they are counted
    texts = held.select(hay_id, F.explode(own).alias("_gram")).join(filed.select("_gram").distinct(), "_gram", "left_semi")
    counts = texts.groupBy("_gram").agg(F.count(F.lit(1)).alias("_texts"))
    rarest = filed.join(counts, "_gram", "left").groupBy("_needle").agg(
        F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_rare")
    )
    key = rarest.filter("_rare.n > 0").select("_needle", F.col("_rare.g").alias("_gram"))
    return texts.join(key, "_gram").select(hay_id, "_needle").distinct()


def _grams_of(text: Column, n: Column) -> Column:
    """`grams` with the length as a column."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda p: F.substr(text, p, n)))


def contains_join(hay: DataFrame, hay_id: str, hay_text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Rows (hay_id, needle columns) where the lower-cased text contains the needle.

    Pairs that share the needle's rarest piece are compared (`contained_candidates`). Null texts contain
    nothing, null and empty needles are in none; repeated rows give repeated pairs.
    """
    keyed = needles.filter(F.length(needle) > 0).withColumn("_needle", F.lower(needle))
    low = hay.select(hay_id, F.lower(hay_text).alias("_low")).filter(F.col("_low").isNotNull())
    pairs = contained_candidates(low, hay_id, keyed).withColumnRenamed(hay_id, "_id")
    met = low.join(pairs, F.col(hay_id).eqNullSafe(F.col("_id"))).filter(F.contains("_low", "_needle")).select(hay_id, "_needle")
    return met.join(keyed, "_needle").drop("_needle")


def keyword_lookup(queries: DataFrame, table: DataFrame, default: str) -> DataFrame:
    """Table rows whose keyword occurs in the query; the row of the `default` keyword where none does.

    queries(query_id, text); table(keyword, pos, ...). The default keyword itself is never searched.
    """
    hits = contains_join(queries, "query_id", "text", table.filter(F.col("keyword") != default), "keyword")
    hits = hits.select("query_id", *table.columns)
    rest = queries.select("query_id").join(hits.select("query_id"), "query_id", "left_anti")
    row = table.filter(F.col("keyword") == default).agg(F.first(F.struct(*table.columns))).scalar()
    return hits.unionByName(rest.withColumn("_d", row).filter(F.col("_d").isNotNull()).select("query_id", "_d.*"))


def match_credit(targets: DataFrame, catalogue: DataFrame) -> DataFrame:
    """First catalogue row (by pos) whose code equals the target or whose name contains it.

    targets(target_id, target); catalogue(pos, code, name) -> (target_id, target, code, name), nulls if none.
    Equal targets are looked up once; of all rows that match only the first one is joined back.
    """
    counted = targets.filter(F.col("target").isNotNull()).groupBy("target").agg(F.count(F.lit(1)).alias("_n"))
    by_code = counted.join(catalogue, F.col("target") == F.col("code")).select("target", "pos")
    by_name = contains_join(catalogue, "pos", "name", counted.select("target"), "target").select("target", "pos")
    first = by_code.unionByName(by_name).groupBy("target").agg(F.min("pos").alias("pos"))
    rows = catalogue.groupBy("pos").agg(F.min(F.struct("code", "name")).alias("m"))
    found = counted.join(first, "target").join(rows, "pos").select("target", "_n", "m")
    return join_to_unique(targets, found, "target", "_n", ["target_id"], how="left").select(
        "target_id", "target", F.col("m.code").alias("code"), F.col("m.name").alias("name")
    )


def with_tracts(sites: DataFrame, tracts: DataFrame, tract: str = "tract") -> DataFrame:
    """sites(tract, …) with the columns of their row of tracts(tract, …), one per tract; nulls where there is none.

    Most sites may lie in a few tracts: these are looked up in a small copy, the others by a join.
    """
    counts = sites.filter(F.col(tract).isNotNull()).groupBy(tract).agg(F.count(F.lit(1)).alias("_n"))
    return join_to_unique(sites, tracts.join(counts, tract), tract, "_n", [c for c in sites.columns if c != tract], how="left")


def template_key(code: Column, name: Column) -> Column:
    """Lookup key: lower-cased code, or name where the code is blank."""
    return F.lower(F.coalesce(F.nullif(F.trim(code), F.lit("")), F.nullif(F.trim(name), F.lit(""))))


def template_dictionary(credits: DataFrame, load_order: list[str]) -> DataFrame:
    """One credit per key; the last one loaded wins."""
    cols = credits.columns
    return (
        credits.withColumn("key", template_key(F.col("credit_code"), F.col("credit_name")))
        .filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.max_by(F.struct(*cols), F.struct(*load_order)).alias("c"))
        .select("key", "c.*")
    )


def exact_templates(identifiers: DataFrame, dictionary: DataFrame) -> DataFrame:
    """identifiers(identifier) with the columns of their template; nulls where there is none."""
    keyed = identifiers.withColumn("key", F.trim(F.lower("identifier")))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    unique = dictionary.join(counts, "key")
    return join_to_unique(keyed, unique, "key", "_n", ["identifier"], how="left")


def name_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def _pieces(text: Column, n: int) -> Column:
    """array<struct<gram, occ>>: the characters (n = 1), or pairs of characters with both ends marked (n = 2)."""
    padded = F.concat(F.lit("\x01"), text, F.lit("\x01")) if n == 2 else F.concat(text, F.lit("\x01"))
    last = F.length(padded) - (n - 1)
    each = F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda p: F.substr(padded, p, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    counted = value_counts(each, key="gram")
    return F.flatten(F.transform(counted, lambda c: F.transform(F.sequence(F.lit(1), c["n"]), lambda j: F.struct(c["gram"].alias("gram"), j.alias("occ")))))


def most_edits(longest: Column, cutoff: float) -> Column:
    """Edits at which strings, the longer one of this length, are still `cutoff` similar (to 6 digits)."""
    return F.floor(longest * (1 - cutoff) + F.lit(1e-6) * F.greatest(longest, F.lit(1))).cast("int")


def name_candidates(names: DataFrame, dictionary: DataFrame, cutoff: float) -> DataFrame:
    """Pairs (name, key) that can be `cutoff` similar: fitting lengths, and a common piece among their rarest ones.

    With L the longer length and e the edits allowed, similar strings share at least L + 1 - 2e pairs of
    characters (L - e characters, for cutoffs up to a half). So if the pieces of each string are ordered
    from rare to frequent, the beginnings that leave out one piece less than that many must meet.
    """
    n = 2 if cutoff > 0.5 else 1
    length = F.length("text")

    def shared(longest: Column) -> Column:
        return longest + 1 - 2 * most_edits(longest, cutoff) if n == 2 else longest - most_edits(longest, cutoff)

    least = F.greatest(F.lit(1), F.array_min(F.transform(F.sequence(length, F.floor(length / cutoff + 1e-6).cast("int")), shared)))
    sides = [
        df.select(F.col(c).alias("text")).filter(F.col("text").isNotNull()).distinct().withColumn("p", _pieces(F.col("text"), n))
        for df, c in ((names, "name"), (dictionary, "key"))
    ]
    often = sides[1].select(F.inline("p")).groupBy("gram", "occ").agg(F.count(F.lit(1)).alias("often"))

    def beginnings(df: DataFrame, name: str) -> DataFrame:
        ranked = df.select("text", F.inline("p")).join(often, ["gram", "occ"], "left").groupBy("text").agg(
            F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram", "occ"))).alias("p")
        )
        first = F.slice("p", F.lit(1), F.greatest(F.lit(0), F.size("p") - least + 1))
        return ranked.select(F.col("text").alias(name), length.alias(f"{name}_length"), F.inline(first)).drop("often")

    met = beginnings(sides[0], "name").join(beginnings(sides[1], "key"), ["gram", "occ"])
    longest = F.greatest("name_length", "key_length")
    return met.filter(F.abs(F.col("name_length") - F.col("key_length")) <= most_edits(longest, cutoff)).select("name", "key").distinct()


def nearest_names(names: DataFrame, dictionary: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """Most similar dictionary key of each distinct name(name), if at least `cutoff` similar (above 0).

    dictionary(key). Only `name_candidates` are compared; equal similarity goes to the least key. Null names
    and keys take no part.
    """
    scored = name_candidates(names, dictionary, cutoff).withColumn("similarity", F.round(name_similarity(F.col("name"), F.col("key")), 6))
    return (
        scored.filter(F.col("similarity") >= cutoff)
        .groupBy("name")
        .agg(F.min(F.struct((-F.col("similarity")).alias("d"), "key")).alias("m"))
        .select("name", F.col("m.key").alias("key"), (-F.col("m.d")).alias("similarity"))
    )


def band_points(value: Column, bands: list[tuple[float, int]]) -> Column:
    """Highest points whose threshold is met, 0 if none. bands: (minimum, points)."""
    return F.greatest(*[F.when(value >= low, F.lit(p)).otherwise(F.lit(0)) for low, p in bands], F.lit(0))


def metres_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def stops_near_sites(sites: DataFrame, stops: DataFrame, radius_m: float) -> DataFrame:
    """Trips of the stops within `radius_m` of each site: (site_id, n_stops, total_trips, weekend_trips).

    sites(site_id, lat, lon); stops(lat, lon, frequency, weekend). Sites and stops that share a place
    are merged before the join, so a crowded place costs one row on each side. Grid cells limit the
    candidates: bands of latitude as high as the radius, each cut into so many cells of longitude that
    a cell is as wide as the radius at the band's far edge; they wrap at the date line, and a band at
    a pole is one cell. Salts split a crowded cell. A place without coordinates is near nothing.
    """
    step = radius_m / 111_000.0

    def n_cells(band: Column) -> Column:
        edge = F.greatest(F.abs(band * step), F.abs((band + 1) * step)) + step
        # 1.6 covers the arc of longitude that a chord spans near a pole
        return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / (1.6 * step)))

    def cell(lon: Column, band: Column) -> Column:
        return F.floor((F.pmod(lon + 180.0, F.lit(360.0))) / 360.0 * n_cells(band))

    places = stops.groupBy("lat", "lon").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("frequency").alias("trips"),
        F.sum(F.when(F.col("weekend"), F.col("frequency")).otherwise(0)).alias("weekend_trips"),
    ).withColumn("cy", F.floor(F.col("lat") / step)).select(
        F.col("lat").alias("slat"), F.col("lon").alias("slon"), "n", "trips", "weekend_trips",
        "cy", F.pmod(cell(F.col("lon"), F.col("cy")), n_cells(F.col("cy"))).alias("cx"),
        F.pmod(F.xxhash64("lat", "lon"), F.lit(8)).alias("salt"),
    )
    spots = sites.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("_n"))
    around = F.sequence(F.lit(-1), F.lit(1))
    own = F.floor(F.col("lat") / step)
    cells = spots.withColumn("cy", F.explode(F.transform(around, lambda d: own + d))).withColumn("_cells", n_cells(F.col("cy"))).withColumn(
        "_at", cell(F.col("lon"), F.col("cy"))
    )
    cells = (
        cells.withColumn("cx", F.explode(F.array_distinct(F.transform(around, lambda d: F.pmod(F.col("_at") + d, F.col("_cells"))))))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
        .select("lat", "lon", "cy", "cx", F.col("salt").cast("long").alias("salt"))
    )
    near = cells.join(places, ["cy", "cx", "salt"]).filter(
        metres_between(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")) <= radius_m
    )
    per_spot = near.groupBy("lat", "lon").agg(
        F.sum("n").alias("n_stops"), F.sum("trips").alias("total_trips"), F.sum("weekend_trips").alias("weekend_trips")
    )
    place = F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string"))
    unique = spots.join(per_spot, ["lat", "lon"]).select(
        place.alias("_place"), "_n", "n_stops", "total_trips", "weekend_trips"
    )
    out = join_to_unique(sites.withColumn("_place", place), unique, "_place", "_n", ["site_id"], how="left")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_stops", "total_trips", "weekend_trips")]
    return out.select("site_id", *zero)


def tables_of_credits(credits: DataFrame, tables: DataFrame) -> DataFrame:
    """(credit_key, table ids in order) for tables on any page of the credit.

    credits(credit_key, doc_id, pages array); tables(doc_id, page, table_id).
    """
    pages = credits.select("credit_key", "doc_id", F.explode(F.array_distinct("pages")).alias("page"))
    return (
        pages.join(tables, ["doc_id", "page"])
        .groupBy("credit_key")
        .agg(F.array_sort(F.collect_set("table_id")).alias("table_ids"))
    )


def unprocessed_files(files: DataFrame, extracted: DataFrame) -> DataFrame:
    """Files without an extraction; both sides have `path`."""
    return files.join(extracted.select("path"), "path", "left_anti")


# ---- fixed values: file types that can be read -------------------------------------------------
READABLE = ["pdf", "xlsx", "xlsm", "xls", "json", "txt", "md", "csv"]
# ------------------------------------------------------------------------------------------------


def with_file_status(files: DataFrame, extracted: DataFrame) -> DataFrame:
    """files(path) with status successful, failed or skipped, and the reason where skipped or failed.

    extracted(path, error): error is null for a good extraction.
    """
    done = extracted.groupBy("path").agg(F.min("error").alias("_error"), F.lit(True).alias("_done"))
    tagged = files.join(done, "path", "left").withColumn(
        "extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    )
    known = F.col("extension").isin(READABLE)
    good = F.coalesce(F.col("_done"), F.lit(False)) & F.col("_error").isNull()
    status = F.when(~known, "skipped").when(good, "successful").otherwise("failed")
    reason = (
        F.when(~known, F.concat(F.lit("Unsupported file type: ."), F.col("extension")))
        .when(good, F.lit(None))
        .otherwise(F.coalesce("_error", F.lit("Extractor returned None")))
    )
    return tagged.select(*files.columns, "extension", status.alias("status"), reason.alias("reason"))
