"""Long fact tables with dimensions: special values, wide form, site metadata, gold rows, site cover.

Facts are (timestamp, variable, site, device, device_type, value) with further columns passed through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsweave.operators.numbering import number_in_order
from obsweave.session import join_small, staged


def with_dimensions(signal: DataFrame, source: DataFrame, source_type: DataFrame, site: DataFrame, variable: DataFrame) -> DataFrame:
    """Facts with the names of their source, its type, site and variable."""
    kinds = source.join(
        source_type.select("source_type_id", F.col("name").alias("source_type"), "manufacturer"), "source_type_id", "left"
    ).select("source_id", "source_type_id", F.col("name").alias("source"), "source_type", "manufacturer")
    out = join_small(signal, variable.select("variable_id", F.col("name").alias("variable"), "unit"), "variable_id", "inner")
    out = join_small(out, kinds, "source_id", "inner")
    return join_small(out, site.select("site_id", F.col("name").alias("site")), "site_id", "inner")


def null_special_values(facts: DataFrame, special: DataFrame) -> DataFrame:
    """Values a device type declares special become null; `special` is (device_type, value)."""
    known = special.where(F.col("value").isNotNull()).select(
        F.col("device_type").alias("_type"), F.col("value").cast("double").alias("_special")
    ).distinct()
    on = (F.col("device_type") == F.col("_type")) & (F.col("value").cast("double") == F.col("_special"))
    joined = join_small(facts, known, on, "left")
    return joined.withColumn("value", F.when(F.col("_type").isNull(), F.col("value"))).select(*facts.columns)


def to_wide(facts: DataFrame, keys: list[str], variables: list[str], order: list[str]) -> DataFrame:
    """One row per key, one column per variable with the first value that is not null, by `order`.

    The variable list is given, so no job looks for it. Rows whose values are all null are left out.
    """
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    present = facts.where(F.col("value").isNotNull() & F.col("variable").isin(variables))
    return present.groupBy(*keys).agg(*[
        F.min_by("value", F.when(F.col("variable") == v, rank)).alias(v) for v in variables
    ])


def device_files(facts: DataFrame) -> DataFrame:
    """Files of the wide export: (site, device, variables, n_rows)."""
    present = facts.where(F.col("value").isNotNull())
    per_variable = present.groupBy("site", "device", "variable").agg(F.count(F.lit(1)).alias("n"))
    variables = per_variable.groupBy("site", "device").agg(F.array_sort(F.collect_list("variable")).alias("variables"))
    stamps = present.select("site", "device", "timestamp").distinct().groupBy("site", "device").agg(F.count(F.lit(1)).alias("n_rows"))
    return variables.join(stamps, ["site", "device"])


def site_metadata(files: DataFrame, devices: DataFrame, variables: DataFrame, sites: DataFrame, special: DataFrame) -> DataFrame:
    """One nested document per site: the site, its devices with their special values, its variables.

    `devices` is (device, device_type, serial, description) and, where known, (type_description, manufacturer), `variables` (variable, unit, description),
    `sites` (site, description), `special` (device_type, value, meaning). A document lists the devices
    and variables of one site; the readings stay out of it.
    """
    docs = special.groupBy("device_type").agg(F.array_sort(F.collect_list(F.struct("value", "meaning"))).alias("special_values"))
    kinds = devices.join(docs, "device_type", "left").withColumn("file", F.concat("device", F.lit(".csv")))
    for name in ("type_description", "manufacturer"):
        if name not in devices.columns:
            kinds = kinds.withColumn(name, F.lit(None).cast("string"))
    device = F.struct("device", "file", "serial", "description", "device_type", "type_description", "manufacturer", F.coalesce("special_values", F.array().cast("array<struct<value:double,meaning:string>>")).alias("special_values"))
    per_site = files.select("site", "device").distinct().join(kinds, "device").groupBy("site").agg(F.array_sort(F.collect_list(device)).alias("devices"))
    used = files.select("site", F.explode("variables").alias("variable")).distinct().join(variables, "variable")
    per_site_vars = used.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("variable", "unit", "description"))).alias("variables"))
    return sites.join(per_site, "site").join(per_site_vars, "site").select(
        "site", F.to_json(F.struct(F.struct("site", "description").alias("site"), "devices", "variables"), {"ignoreNullFields": "false"}).alias("metadata")
    )


def site_gold(files: DataFrame, variable_gold: DataFrame) -> DataFrame:
    """Gold rows of every wide column whose variable has one; excluded variables have none."""
    columns = files.select("site", "device", F.explode("variables").alias("variable"))
    return join_small(columns, variable_gold, "variable", "inner")


def unknown_variables(files: DataFrame, variable_gold: DataFrame, excluded: DataFrame) -> DataFrame:
    """Variables of the export that are neither in the gold nor excluded."""
    seen = files.select(F.explode("variables").alias("variable")).distinct()
    known = variable_gold.select("variable").union(excluded.select("variable"))
    return seen.join(known, "variable", "left_anti")


def without_data(declared: DataFrame, facts: DataFrame) -> DataFrame:
    """Declared variables no fact has."""
    return declared.join(facts.select("variable").distinct(), "variable", "left_anti")


def samples_per_variable(facts: DataFrame, order: list[str], n: int = 1) -> DataFrame:
    """First n facts of every variable. Each task keeps n per variable before the shuffle."""
    by = Window.partitionBy("variable").orderBy(*order)
    return facts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def site_manifest(files: DataFrame, gold_columns: DataFrame) -> DataFrame:
    """Files, columns, gold columns and gold variables per site."""
    have = files.groupBy("site").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("variables")).alias("columns"))
    # first to the distinct variables of a site, so that a list never sees a row per device
    per_variable = gold_columns.groupBy("site", "variable").agg(F.count(F.lit(1)).alias("n"))
    gold = per_variable.groupBy("site").agg(
        F.sum("n").alias("gold_columns"), F.array_sort(F.collect_list("variable")).alias("gold_variables")
    )
    return have.join(gold, "site", "left").select(
        "site", "files", "columns", F.coalesce("gold_columns", F.lit(0)).alias("gold_columns"),
        F.coalesce("gold_variables", F.array().cast("array<string>")).alias("gold_variables"),
    )


def greedy_cover(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    """Sites that cover all variables: each step takes the site with most uncovered variables, then
    the lowest cost, then the first name.

    `pairs` is (site, variable), `costs` (site, columns). A site that comes before all sites with which it shares an
    uncovered variable keeps its gain until it is taken, as only those could lower it and theirs never rise. A round
    takes all such sites at once. Gains fall from step to step, so the steps are the order of (gain, cost, name) at
    the time of taking. There are as many rounds as the longest chain of sites that wait for one another; only whether
    variables are left reaches the driver.
    """
    known = costs.select("site", "columns")
    left = staged(pairs.select("site", "variable").distinct().join(known, "site"), "cover")
    taken = left.select("site", "columns", F.lit(0).cast("long").alias("gain")).limit(0)
    while not left.isEmpty():
        gains = left.groupBy("site").agg(F.count(F.lit(1)).alias("gain"))
        place = F.struct((-F.col("gain")).alias("loss"), "columns", "site")
        placed = join_small(left, gains, "site", "inner").withColumn("place", place)
        firsts = placed.groupBy("variable").agg(F.min("place").alias("first"))
        won = join_small(placed, firsts, "variable", "inner").groupBy("site", "columns", "gain").agg(F.bool_and(F.col("place") == F.col("first")).alias("won"))
        won = staged(won.where("won").drop("won"), "cover-taken")
        taken = taken.unionByName(won)
        covered = join_small(left, won.select("site"), "site", "left_semi").select("variable").distinct()
        left = staged(join_small(left, covered, "variable", "left_anti"), "cover")
    steps = number_in_order(taken, [], [F.desc("gain"), "columns", "site"], "step")
    return steps.select(F.col("step").cast("int").alias("step"), "site", "gain")
