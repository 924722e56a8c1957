"""Reading answers of address registries and DNS that were looked up elsewhere; nothing here uses a network."""

from __future__ import annotations

from ipaddress import ip_address

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_RDAP = "STRUCT<handle STRING, name STRING, type STRING, country STRING, startAddress STRING, endAddress STRING, ipVersion STRING, cidr0_cidrs ARRAY<STRUCT<v4prefix STRING, v6prefix STRING, length INT>>, events ARRAY<STRUCT<eventAction STRING, eventDate STRING>>, links ARRAY<STRUCT<rel STRING, href STRING>>>"


@pandas_udf(T.StringType())
def origin_host(ip: pd.Series) -> pd.Series:
    """The DNS name under which an address's network origin is published: its octets or nibbles in reverse."""

    def host(x: str | None) -> str | None:
        try:
            pointer = ip_address(x).reverse_pointer
        except ValueError:
            return None
        return pointer.replace(".in-addr.arpa", ".origin.asn.cymru.com").replace(".ip6.arpa", ".origin6.asn.cymru.com")

    return ip.map(host)


def parse_origin(answer: Column) -> Column:
    """(asn, network, country_code, registry) of an origin answer 'asn | prefix | country | registry | date'."""
    part = lambda k: F.nullif(F.trim(F.split_part(answer, F.lit("|"), F.lit(k))), F.lit(""))
    return F.struct(
        F.split_part(part(1), F.lit(" "), F.lit(1)).try_cast("long").alias("asn"), part(2).alias("network"), part(3).alias("country_code"),
        part(4).alias("registry"),
    )


def flatten_rdap(answer: Column) -> Column:
    """The fields of a registry's JSON answer that reports show; four links at most; null for broken JSON."""
    raw = F.from_json(answer, _RDAP)
    cidr = F.filter(
        F.transform(
            raw["cidr0_cidrs"],
            lambda x: F.when(
                x["length"] > 0, F.concat_ws("/", F.coalesce(F.nullif(x["v4prefix"], F.lit("")), F.nullif(x["v6prefix"], F.lit(""))), x["length"]),
            ),
        ),
        lambda x: x.isNotNull() & x.contains("/"),
    )
    dated = lambda *names: F.get(F.filter(raw["events"], lambda e: F.lower(e["eventAction"]).isin(*names)), F.lit(0))["eventDate"]
    links = F.slice(F.filter(raw["links"], lambda x: F.coalesce(x["href"], F.lit("")) != ""), 1, 4)
    return F.when(
        raw["handle"].isNotNull() | raw["name"].isNotNull(),
        F.struct(
            raw["handle"].alias("handle"), raw["name"].alias("name"), raw["type"].alias("type"), raw["country"].alias("country_code"),
            raw["startAddress"].alias("start_address"), raw["endAddress"].alias("end_address"), cidr.alias("cidrs"),
            dated("registration").alias("registration"), dated("last changed", "last update of rdap database").alias("last_changed"),
            links.alias("links"),
        ),
    )


def forward_confirmed(reverse: DataFrame, forward: DataFrame) -> DataFrame:
    """(ip, forward_confirmed): whether one of an address's names (ip, name) resolves back to it (name, ip)."""
    hits = reverse.join(forward.select("name", F.col("ip").alias("__back")), "name", "left").groupBy("ip").agg(
        F.max(F.coalesce(F.col("__back") == F.col("ip"), F.lit(False))).alias("forward_confirmed")
    )
    return hits
