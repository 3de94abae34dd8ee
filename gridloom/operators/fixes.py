"""Dataset fixes: derived columns and attribute edits, by recipe.

Every fix takes and returns a DataFrame with a dataset id (and, where it says so, an ``attrs`` map
or a ``time``), so a recipe is a chain of ``transform`` calls.  Running a recipe twice changes
nothing more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORECAST_PREFIX, ATLAS_PREFIX = "c3s-cmip6-decadal", "c3s-cica-atlas"
Fix = Callable[[DataFrame], DataFrame]


def token(k: int) -> Column:
    return F.get(F.split("dataset_id", "\\."), F.lit(k))


def start_year() -> Column:
    return F.nullif(F.regexp_extract(token(5), "^s?([0-9]+)-", 1), F.lit("")).cast("int")


def start_date() -> Column:
    """1 November of the year in the id's sixth token."""
    return F.make_date(start_year(), F.lit(11), F.lit(1))


def sub_experiment() -> Column:
    return F.when(start_year().isNotNull(), F.format_string("s%d%d", start_year(), F.lit(11)))


def reference_time(attr: Column) -> Column:
    """From an attribute ``sYYYYMM`` with a real month, else the start date."""
    y, m = (F.nullif(F.regexp_extract(attr, "^s([0-9]{4})([0-9]{2})$", k), F.lit("")).cast("int") for k in (1, 2))
    given = F.when(m.between(1, 12), F.make_date(y, F.when(m.between(1, 12), m).otherwise(1), F.lit(1)))
    return F.coalesce(given, start_date()).cast("timestamp_ntz")


def lead_days() -> Column:
    """Whole days from the start date to the cell's time."""
    return F.floor(F.timestamp_diff("SECOND", start_date().cast("timestamp_ntz"), F.col("time")) / 86400).cast("long")


def project() -> Column:
    return token(0)


def set_attr(key: str, value: Column) -> Fix:
    return lambda df: df.withColumn("attrs", F.map_concat(F.map_filter("attrs", lambda k, v: k != key), F.create_map(F.lit(key), value)))


def set_missing(key: str, value: Column) -> Fix:
    """Set where absent or empty."""
    return set_attr(key, F.coalesce(F.nullif(F.element_at("attrs", key), F.lit("")), value))


def remove_attr(key: str) -> Fix:
    return lambda df: df.withColumn("attrs", F.map_filter("attrs", lambda k, v: k != key))


def relabel_calendar(df: DataFrame) -> DataFrame:
    """proleptic_gregorian becomes standard; dates stay as they read."""
    return df.withColumn("calendar", F.when(F.col("calendar") == "proleptic_gregorian", "standard").otherwise(F.col("calendar")))


def squeeze(df: DataFrame, *dims: str) -> DataFrame:
    """Without the dimensions that have a single value."""
    counts = df.agg(*[F.count_distinct(d).alias(d) for d in dims]).first()
    return df.drop(*[d for d in dims if counts[d] <= 1])


def add_scalar(name: str, value) -> Fix:
    """A coordinate with one value for all cells."""
    return lambda df: df.withColumn(name, F.lit(value))


def add_along(name: str, dim: str, values: DataFrame) -> Fix:
    """A coordinate along a dimension, from a table (dim, name); positions without a value have NULL."""
    return lambda df: df.join(values.select(dim, name).dropDuplicates([dim]), dim, "left")


def signature(attrs: Column, names: list[str], widest: int = 80) -> list[Column]:
    """For each named attribute whether it is set, and its value, cut where it is longer than ``widest``."""
    cut = lambda c: F.when(F.length(c) > widest, F.concat(F.left(c, F.lit(widest - 3)), F.lit("..."))).otherwise(c)
    return [x for n in names for x in (F.map_contains_key(attrs, n).alias(f"has_{n}"), cut(F.element_at(attrs, n)).alias(n))]


#: Names that recipes may use for derived attributes -> their columns; nothing is imported by name.
DERIVED: dict[str, Callable[[], Column]] = {
    "start_date": lambda: start_date(),
    "sub_experiment": lambda: sub_experiment(),
    "lead_days": lambda: lead_days(),
    "project": lambda: project(),
    "model": lambda: token(3),
}


def derive(column: str, name: str) -> Fix:
    """The column, derived by a registered name."""
    if name not in DERIVED:
        raise ValueError(f"unknown derivation {name}; known: {', '.join(sorted(DERIVED))}")
    return lambda df: df.withColumn(column, DERIVED[name]())


def ordinal(calendar: Column, y: Column, m: Column, d: Column) -> Column:
    """Day number within its calendar; days past the 30th count as the 30th in a 360-day year."""
    before = F.element_at(F.array(*[F.lit(x) for x in (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)]), m)
    leap = F.when(m > 2, 1).otherwise(0)
    return (
        F.when(calendar == "360_day", y * 360 + (m - 1) * 30 + F.least(d, F.lit(30)) - 1)
        .when(calendar.isin("noleap", "365_day"), y * 365 + before + d - 1)
        .when(calendar.isin("all_leap", "366_day"), y * 366 + before + leap + d - 1)
        .otherwise(F.unix_date(F.make_date(y, m, d)))
    )


#: Most models whose texts are broadcast; more are joined by shuffle.
MOST_MODELS = 100_000


def model_descriptions(df: DataFrame, models: DataFrame) -> DataFrame:
    """Fixed texts of the model in the id's fourth token; a model without texts has NULLs."""
    few = models.limit(MOST_MODELS + 1).count() <= MOST_MODELS
    return df.withColumn("model", token(3)).join(F.broadcast(models) if few else models, "model", "left")


def prepared(df: DataFrame) -> DataFrame:
    return df.withColumn("start_date", start_date()).withColumn("sub_experiment_id", sub_experiment())


def applied(df: DataFrame) -> DataFrame:
    return df.withColumn("reftime", reference_time(F.element_at("attrs", "startdate"))).withColumn("leadtime", lead_days()).withColumn("realization", F.element_at("attrs", "realization_index").cast("int"))


def forecast(df: DataFrame) -> DataFrame:
    """The whole forecast chain: calendar, attributes, experiment, reference time, lead time, member."""
    df = relabel_calendar(df).transform(set_attr("long_name", F.lit("valid_time"))).transform(set_missing("startdate", sub_experiment()))
    return prepared(df).transform(applied)


def atlas(df: DataFrame) -> DataFrame:
    return df.withColumn("project_id", project())


#: Recipe -> fix; the dataset id decides which applies.
RECIPES: dict[str, Fix] = {"c3s.cmip6_decadal": forecast, "c3s.atlas": atlas}


def recipe_of(dataset_id: Column) -> Column:
    """Only sources with a catalog id are fixed."""
    return F.when(dataset_id.startswith(ATLAS_PREFIX), "c3s.atlas").when(dataset_id.startswith(FORECAST_PREFIX), "c3s.cmip6_decadal")


def apply(df: DataFrame, recipe: str) -> DataFrame:
    if recipe not in RECIPES:
        raise ValueError(f"unknown recipe {recipe}; known: {', '.join(RECIPES)}")
    return RECIPES[recipe](df)


def statistics(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows tried and changed per dataset."""
    a = before.select(*key, F.struct(*columns).alias("a"))
    b = after.select(*key, F.struct(*columns).alias("b"))
    return a.join(b, key).groupBy("dataset_id").agg(F.count("*").alias("attempted"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))
