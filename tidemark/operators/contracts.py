"""Contract assertions: named boolean Columns over nested rows, counted or enforced, and the schemas they stand on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.evidence import WIND_MAX, WIND_MIN, has_banned_language

SUM_TOLERANCE = 1e-6
MANIFEST = (
    "case_id string, seed long, t_start timestamp, t_obs timestamp, aoi struct<min_lon:double,min_lat:double,max_lon:double,max_lat:double>, scene struct<polarisation:string,product:string,pixel_spacing_m:double>"
)
FORCING = "t_start timestamp, t_obs timestamp, working_crs string, includes_stokes boolean, wind_variables array<string>, currents_resolution_deg double, wind_resolution_deg double"
REQUIRED_LOG = ("timestamp", "mmsi", "lat", "lon", "sog_kn", "cog_deg")


def assert_schema(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """df, or an error if a required column is missing. Looks at the schema alone; more columns are fine."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def assert_utc(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error if a column is not an instant (timestamps without a time zone are refused)."""
    for c in columns:
        if not isinstance(df.schema[c].dataType, T.TimestampType):
            raise ValueError(f"{c} must be an instant, not {df.schema[c].dataType.simpleString()}")
    return df


def box_ordered(b: str) -> Column:
    f = lambda c: F.col(f"{b}.{c}")
    return (f("min_lon") < f("max_lon")) & (f("min_lat") < f("max_lat")) & f("min_lon").between(-180, 180) & f("max_lon").between(-180, 180) & f("min_lat").between(-90, 90) & f("max_lat").between(-90, 90)


def box_centroid(b: str) -> tuple[Column, Column]:
    """Longitude and latitude of a box's middle."""
    f = lambda c: F.col(f"{b}.{c}")
    return (f("min_lon") + f("max_lon")) / 2, (f("min_lat") + f("max_lat")) / 2


def lookback_hours(a: str, b: str) -> Column:
    return (F.unix_micros(F.col(b)) - F.unix_micros(F.col(a))) / 3.6e9


def co_polarised(polarisation: str) -> Column:
    """VV and HH are co-polarised; detection takes no other."""
    return F.upper(F.col(polarisation)).isin("VV", "HH")


def ring_valid(ring: str) -> Column:
    """At least four vertices, closed, in range."""
    r = F.col(ring)
    inside = F.forall(r, lambda p: p["lon"].between(-180, 180) & p["lat"].between(-90, 90))
    return (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)) & inside


def window_ordered(a: str, b: str) -> Column:
    return F.col(a) < F.col(b)


def window_at_least(a: str, b: str, hours: float) -> Column:
    return F.col(b).cast("long") - F.col(a).cast("long") >= hours * 3600


def case_id_valid(c: str) -> Column:
    return F.col(c).rlike("^[a-z0-9_]+$")


def crs_valid(c: str) -> Column:
    return F.col(c).rlike(r"^EPSG:\d{4,5}$")


def wind_is_components(names: str) -> Column:
    """Variables are components; a speed or bearing is refused."""
    low = F.transform(F.col(names), F.lower)
    return ~F.arrays_overlap(low, F.array(*map(F.lit, ("speed", "direction", "bearing", "wind_speed", "wind_direction", "ws", "wd"))))


def abstention_consistent(abstained: str, kind: str) -> Column:
    return F.col(abstained) == (F.col(kind) == "undetermined")


def wind_gate_enforced(wind: str, kind: str) -> Column:
    return F.col(wind).between(WIND_MIN, WIND_MAX) | (F.col(kind) == "undetermined")


def abstention_explained(abstained: str, reason: str) -> Column:
    return ~F.col(abstained) | F.contains(F.coalesce(F.col(reason), F.lit("")), F.lit("Outside detectability window"))


def density_valid(values: str) -> Column:
    return F.forall(F.col(values), lambda v: v >= 0)


def sums_to_one(values: str) -> Column:
    """Whether weights that are all there sum to 1."""
    total = F.aggregate(F.col(values), F.lit(0.0), lambda a, v: a + v)
    return F.coalesce(F.abs(total - 1) <= SUM_TOLERANCE, F.lit(False))


def interval_ordered(interval: str) -> Column:
    return F.col(f"{interval}.start") < F.col(f"{interval}.end")


def levels_nest(regions: str) -> Column:
    """Levels 50 and 95 are there, and the inner one is strictly smaller."""
    r = F.col(regions)
    return F.map_contains_key(r, "50") & F.map_contains_key(r, "95") & (F.element_at(r, "50") < F.element_at(r, "95"))


def ess_bounded(ess: str, particles: str) -> Column:
    return F.col(ess) <= F.col(particles)


def envelope_honest(lookback_h: str, within: str) -> Column:
    return (F.col(lookback_h) <= 72) | ~F.col(within)


def language_neutral(text: str) -> Column:
    return ~has_banned_language(F.col(text))


def funnel_monotone(reported: str, prefiltered: str, window: str) -> Column:
    return (F.col(reported) <= F.col(prefiltered)) & (F.col(prefiltered) <= F.col(window))


def seed_rules() -> dict[str, Column]:
    """Seeds have a position, a time, an identifier and a source each, none of them missing or not a number."""
    whole = F.col("particle_id").isNotNull() & F.col("origin").isNotNull()
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return {"seed_identified": whole, "seed_placed": there("x") & there("y"), "seed_timed": there("seed_time")}


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows, violated), all rules in one pass; a rule that is null counts as violated."""
    counted = df.agg(F.count("*").alias("rows"), *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col("rows"), F.col(n).alias("violated")) for n in rules])
    return counted.select(F.explode(pairs).alias("r")).select("r.*")


def enforce(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, failing when it runs on the first row that breaks a rule."""
    for name, rule in rules.items():
        df = df.filter(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"contract broken: {name}")).isNull()))
    return df


def ranking_violations(ranked: DataFrame, case: str = "case_id") -> DataFrame:
    """One row a case (case, rank, probability, dark_probability): whether ranks run 1..n, probabilities fall and all sum
    to 1, and whether the source that does not transmit is the most probable."""
    order = Window.partitionBy(case).orderBy("rank")
    rows = ranked.withColumn("_nth", F.row_number().over(order)).withColumn("_before", F.lag("probability").over(order))
    return rows.groupBy(case).agg(
        F.bool_and(F.col("_nth") == F.col("rank")).alias("contiguous"), F.bool_and(F.coalesce(F.col("_before") >= F.col("probability"), F.lit(True))).alias("ordered"),
        (F.abs(F.sum("probability") + F.max("dark_probability") - 1) <= SUM_TOLERANCE).alias("normalised"), (F.max("dark_probability") > F.max("probability")).alias("dark_is_top"),
    )
