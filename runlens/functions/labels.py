"""Column functions over runner labels: billing and machine size."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Minutes charged per minute used, by hosted runner label.
RATES = {
    "ubuntu-latest": 1.0,
    "ubuntu-24.04": 1.0,
    "ubuntu-22.04": 1.0,
    "ubuntu-20.04": 1.0,
    "windows-latest": 2.0,
    "windows-2025": 2.0,
    "windows-2022": 2.0,
    "windows-2019": 2.0,
    "macos-latest": 10.0,
    "macos-15": 10.0,
    "macos-14": 10.0,
    "macos-13": 10.0,
}
SELF_HOSTED = "self-hosted"


def labels_from_text(text: Column) -> Column:
    """List of a comma-joined text; missing or empty text is an empty list."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def labels_to_text(labels: Column) -> Column:
    return F.concat_ws(",", labels)


def is_self_hosted(labels: Column) -> Column:
    return F.coalesce(F.exists(labels, lambda x: F.lower(x) == SELF_HOSTED), F.lit(False))


def _larger_runner_rate(label: Column) -> Column:
    digits = F.regexp_extract(label, r"-(\d+)-cores?$", 1)
    cores = F.nullif(digits, F.lit("")).try_cast("double")
    rate = (
        F.when(label.startswith("windows"), cores)
        .when(label.startswith("macos"), cores * 5)
        .otherwise(cores / 2)
    )
    return F.when(cores >= 2, rate)


def multiplier(labels: Column, rates: dict[str, float] | None = None) -> Column:
    """Charge per minute: 0 self-hosted, else the first label with a known rate or core suffix, else 1."""
    table = F.create_map(*[F.lit(x) for pair in (RATES if rates is None else rates).items() for x in pair])

    def rate(label):
        name = F.lower(label)
        return F.coalesce(F.try_element_at(table, name), _larger_runner_rate(name))

    known = F.filter(F.transform(labels, rate), lambda r: r.isNotNull())
    return F.when(is_self_hosted(labels), F.lit(0.0)).otherwise(
        F.coalesce(F.try_element_at(known, F.lit(1)), F.lit(1.0))
    )


def multipliers(sets: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds ``multiplier`` to rows of label texts (``labels``) from a rate table ``(label, rate)`` of any size.

    The rule is that of :func:`multiplier`; the table takes the place of the built-in rates. Of a label that the
    table has twice, the higher rate counts.
    """
    table = rates.groupBy(F.lower("label").alias("_name")).agg(F.max(F.col("rate").cast("double")).alias("_rate"))
    each = sets.select("labels", F.posexplode(labels_from_text(F.col("labels"))).alias("_at", "_label")).distinct()
    each = each.withColumn("_name", F.lower("_label")).join(table, "_name", "left")
    known = each.withColumn("_rate", F.coalesce("_rate", _larger_runner_rate(F.col("_name")))).filter("_rate IS NOT NULL")
    first = known.groupBy("labels").agg(F.min_by("_rate", "_at").alias("_first"))
    hosted = is_self_hosted(labels_from_text(F.col("labels")))
    return sets.join(first, "labels", "left").withColumn(
        "multiplier", F.when(hosted, 0.0).otherwise(F.coalesce("_first", F.lit(1.0)))).drop("_first")


def billable_minutes(seconds: Column) -> Column:
    return F.when(seconds > 0, F.ceil(seconds / 60).cast("double")).otherwise(F.lit(0.0))


def core_count(label: Column) -> Column:
    """Cores a label names (``16vcpu``, ``8cores`` as a token of its own), else the usual size of its system."""
    name = F.lower(label)
    found = F.regexp_extract_all(name, F.lit(r"(?:^|(?<=-))(\d+)(?:vcpu|cores?)(?=-|$)"), F.lit(1))
    sizes = F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda n: n > 0)
    named = F.try_element_at(sizes, F.lit(1))
    usual = (
        F.when(name.contains("ubuntu") | name.contains("linux"), F.lit(2))
        .when(name.contains("windows"), F.lit(2))
        .when(name.contains("macos"), F.lit(4))
        .otherwise(F.lit(0))
    )
    return F.coalesce(named, usual)
