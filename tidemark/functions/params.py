"""Query-parameter extraction, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parameter names by family.
CLICK_IDS = ("gclid", "fbclid", "msclkid", "dclid", "gad_source", "gbraid", "wbraid", "gad_campaignid")
CAMPAIGN = ("campaign", "cid", "x-campaign")
LONGEST_VALUE = 512


def param_of(pair: Column) -> Column:
    """The name before the first '=', lower-cased, without leading question marks."""
    return F.lower(F.ltrim(F.split_part(pair, F.lit("="), F.lit(1)), F.lit("?")))


def value_of(pair: Column) -> Column:
    """What follows the first '=', as it stands; '' without one. 512 characters at most."""
    at = F.instr(pair, "=")
    return F.when(at > 0, F.substring(pair, at + 1, F.lit(LONGEST_VALUE))).otherwise("")


def family_of(param: Column) -> Column:
    return (
        F.when(param == "srsltid", "srsltid")
        .when(param.startswith("utm_"), "utm")
        .when(param.isin(*CLICK_IDS), "click_id")
        .when(param.isin(*CAMPAIGN), "campaign")
        .when(param.startswith("wpv_"), "wpv")
        .otherwise("other")
    )


def with_params(events: DataFrame) -> DataFrame:
    """A row for each named parameter of each event's query: param, param_value, param_family."""
    pairs = events.where(F.coalesce(F.col("query"), F.lit("")) != "").withColumn("__pair", F.explode(F.split("query", "&")))
    named = pairs.withColumns({"param": param_of(F.col("__pair")), "param_value": value_of(F.col("__pair"))}).where("param <> ''")
    return named.withColumn("param_family", family_of(F.col("param"))).drop("__pair")
