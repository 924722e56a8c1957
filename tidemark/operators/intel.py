"""IP intelligence: CIDR lists, longest-prefix matches, the order in which evidence is put together, and merges."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from ipaddress import ip_address, ip_network

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tidemark.functions import trust

_TOKEN = re.compile(r"(?i)\b(?:\d{1,3}\.){3}\d{1,3}(?:/\d{1,2})?\b|(?:[0-9a-f]{0,4}:){2,}[0-9a-f]{0,4}(?:/\d{1,3})?")
_AROUND = ".,;:()[]{}<>\"'"


def normal_cidr(text: str) -> str | None:
    """A network with its host bits cleared; single addresses become /32 or /128; unspecified and loopback
    addresses, and what is no address, give None."""
    text = text.strip().strip(_AROUND)
    try:
        base = ip_address(text.partition("/")[0])
        if base.is_unspecified or base.is_loopback or "%" in text:
            return None
        return str(ip_network(text, strict=False))
    except ValueError:
        return None


def json_strings(value: object) -> Iterator[str]:
    """Every string leaf of a parsed JSON document."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, (list, dict)):
        for child in value.values() if isinstance(value, dict) else value:
            yield from json_strings(child)


@pandas_udf(T.ArrayType(T.StringType()))
def document_ranges(body: pd.Series, kind: pd.Series) -> pd.Series:
    """Sorted, distinct networks of a provider's document; kind is ``json`` or ``text``. Broken JSON has none."""

    def read(text: str, kind: str) -> list[str]:
        try:
            raw = list(json_strings(json.loads(text))) if kind == "json" else _TOKEN.findall(text)
        except ValueError:
            raw = []
        return sorted({c for c in map(normal_cidr, raw) if c})

    return pd.Series([read(b or "", k) for b, k in zip(body, kind, strict=True)])


def provider_ranges(documents: DataFrame) -> DataFrame:
    """(provider_id, provider_name, actor_type, source_url, cidr) of documents with (…, kind, body)."""
    return documents.select("provider_id", "provider_name", "actor_type", "source_url", F.explode(document_ranges("body", "kind")).alias("cidr")).distinct()


@pandas_udf(T.StringType())
def address_bits(text: pd.Series) -> pd.Series:
    """An address as its 32 or 128 bits, null if it is none. IPv4 addresses mapped into IPv6 count as IPv4."""

    def bits(x: str | None) -> str | None:
        try:
            ip = ip_address(x)
        except ValueError:
            return None
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return f"{int(ip):0{ip.max_prefixlen}b}"

    return text.map(bits)


#: An IPv4 address as people write it; other texts are left to Python.
_PLAIN_V4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def with_bits(rows: DataFrame, column: str, name: str = "__bits") -> DataFrame:
    """``rows`` with the bits of an address column, in one read; Python sees nulls but for what is no plain IPv4 address.
    Rows without an address go."""
    octet = lambda k: F.lpad(F.bin(F.split(column, r"\.")[k].cast("int")), 8, "0")
    marked = rows.withColumn("__plain", F.coalesce(F.col(column).rlike(_PLAIN_V4), F.lit(False)))
    read = marked.withColumn("__other", address_bits(F.when(~F.col("__plain"), F.col(column))))
    return read.withColumn(name, F.when(F.col("__plain"), F.concat(*map(octet, range(4)))).otherwise(F.col("__other"))).where(F.col(name).isNotNull()).drop("__plain", "__other")


def prefix_matches(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ip, __n, columns of ``ranges``) for each range (cidr, ...) that holds an address of ``ips``; __n is its length.

    Ranges meet addresses by equality on (number of bits, prefix), once for each prefix length that occurs: no comparison of
    every address with every range, and for hot prefixes the join may be dealt anew, as for any other key."""
    named = [c for c in ranges.columns if c != "ip"]
    parts = F.split("cidr", "/")
    own = with_bits(
        ranges.withColumns({"__base": parts[0], "__n": parts[1].cast("int")}), "__base",
    ).withColumn("__prefix", F.expr("left(__bits, __n)")).withColumn("__size", F.length("__bits"))
    lengths = own.groupBy("__size").agg(F.collect_set("__n").alias("__ns"))  # two rows at most, of 33 and 129 lengths
    asked = with_bits(ips.select("ip").distinct(), "ip").withColumn("__size", F.length("__bits"))
    tried = asked.join(F.broadcast(lengths), "__size").withColumn("__n", F.explode("__ns")).withColumn("__prefix", F.expr("left(__bits, __n)")).select("ip", "__size", "__n", "__prefix")
    return tried.join(own.select("__size", "__n", "__prefix", *named), ["__size", "__n", "__prefix"]).select("ip", "__n", *named)


def longest_prefix(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ips`` (ip, ...) with the columns of the longest range (cidr, ...) that holds each; ties by provider_id, then cidr. Rows without a
    match stay, with nulls."""
    named = [c for c in ranges.columns if c != "ip"]
    order = F.struct(-F.col("__n"), *([F.col("provider_id")] if "provider_id" in named else []), F.col("cidr"))
    best = prefix_matches(ips, ranges).groupBy("ip").agg(F.min_by(F.struct(*named), order).alias("__best")).select("ip", "__best.*")
    return ips.join(best, "ip", "left")


def located(ips: DataFrame, blocks: DataFrame) -> DataFrame:
    """``ips`` with country_code, region and city of the network of a location table (cidr, country_code,
    registered_country_code, region, city) that holds them; the country of registration stands in for a missing one."""
    own = blocks.select("cidr", F.coalesce("country_code", "registered_country_code").alias("country_code"), "region", "city")
    return longest_prefix(ips, own).drop("cidr")


def allowlisted(ips: DataFrame, allowlist: DataFrame) -> DataFrame:
    """``ips`` with the first entry, by ``position``, of an allowlist (position, cidr, label, actor_type) that holds it."""
    entries = allowlist.select(
        "position",
        F.when(F.col("cidr").contains("/"), F.col("cidr")).otherwise(
            F.concat("cidr", F.when(F.col("cidr").contains(":"), "/128").otherwise("/32"))
        ).alias("cidr"),
        F.col("label").alias("allow_label"), F.col("actor_type").alias("allow_type"),
    )
    met = prefix_matches(ips, entries)
    first = met.groupBy("ip").agg(F.min_by("allow_label", "position").alias("allow_label"), F.min_by("allow_type", "position").alias("allow_type"))
    return ips.join(first, "ip", "left")


def assemble(ips: DataFrame) -> DataFrame:
    """Put the evidence together, each step over the last: reverse DNS or volume, network organisation, official
    ranges, rented machines, traffic, allowlist.

    Takes ip, names (array), forward_confirmed, asn_org, is_tor_exit, provider_name, provider_type, allow_label,
    allow_type, requests, status_4xx, status_5xx; adds actor_type, known_actor, risk_score, verified_actor,
    is_datacenter and provider_verified.
    """
    out = ips.withColumn("__a", trust.classify_reverse_dns(F.col("names"), F.col("requests")))
    out = out.withColumn(
        "verified_actor",
        F.coalesce("forward_confirmed", F.lit(False)) & (F.col("__a.known_actor") != "") & ~trust.is_infrastructure(F.col("__a.actor_type")),
    )
    tor = F.coalesce("is_tor_exit", F.lit(False))
    out = out.select(
        "*", F.when(tor, "tor").otherwise(F.col("__a.actor_type")).alias("__t"),
        F.when(tor, "Tor exit").otherwise(F.col("__a.known_actor")).alias("__k"),
        F.when(tor, F.greatest(F.col("__a.risk_score"), F.lit(80))).otherwise(F.col("__a.risk_score")).alias("__r"),
    )
    out = out.withColumn("__o", trust.network_org(F.col("__t"), F.col("__k"), F.col("__r"), F.col("asn_org"), tor))
    official = F.col("provider_name").isNotNull()
    out = out.withColumn("provider_verified", official).withColumn("__t", F.when(official, F.col("provider_type")).otherwise(F.col("__o.actor_type"))).withColumn(
        "__k", F.when(official, F.col("provider_name")).otherwise(F.col("__o.known_actor")),
    )
    out = out.withColumn("__r", F.when(official, F.greatest(F.col("__o.risk_score"), trust.provider_baseline(F.col("provider_type")))).otherwise(F.col("__o.risk_score")))
    out = out.withColumn("is_datacenter", trust.is_infrastructure(F.col("__t")))
    out = out.withColumn("__r", trust.traffic_risk(F.col("__r"), F.col("requests"), F.col("status_4xx"), F.col("status_5xx"), official | F.col("is_datacenter")))
    allow = F.col("allow_label").isNotNull()
    return out.select(
        *ips.columns, F.when(allow, F.col("allow_type")).otherwise(F.col("__t")).alias("actor_type"), F.when(allow, F.col("allow_label")).otherwise(F.col("__k")).alias("known_actor"),
        F.when(allow, F.when((F.col("__r") == 0) | (F.col("__r") > 10), 10).otherwise(F.col("__r"))).otherwise(F.col("__r")).cast("int").alias("risk_score"), (allow | F.col("verified_actor")).alias("verified_actor"), "is_datacenter", "provider_verified",
    )


def merge(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored intelligence overlaid with fresh rows: fresh values where they are not null; a person's action, label
    and the risk that goes with it stay."""
    kept = {"manual_action", "manual_label"}
    s, f = stored.alias("s"), fresh.alias("f")
    out = []
    for name in dict.fromkeys([*stored.columns, *fresh.columns]):
        old = F.col(f"s.{name}") if name in stored.columns else None
        new = F.col(f"f.{name}") if name in fresh.columns else None
        if old is None or new is None:
            out.append((new if old is None else old).alias(name))
        elif name in kept:
            out.append(F.coalesce(old, new).alias(name))
        elif name == "risk_score" and "manual_action" in stored.columns:
            out.append(
                F.when(
                    F.coalesce(F.col("s.manual_action"), F.lit("")).isin("suspicious", "verified", "allowlisted"), old,
                ).otherwise(F.coalesce(new, old)).alias(name)
            )
        else:
            out.append(F.coalesce(new, old).alias(name))
    return s.join(f, F.col("s.ip") == F.col("f.ip"), "full_outer").select(*out)


def refresh_candidates(rollup: DataFrame, limit: int = 500) -> DataFrame:
    """The busiest addresses of rollup_ip_1h rows, with what the risk rules need."""
    return rollup.groupBy(F.col("client_ip").alias("ip")).agg(
        *(F.sum(n).alias(n) for n in ("requests", "status_4xx", "status_5xx"))
    ).orderBy(F.desc("requests"), "ip").limit(limit)


def backfill_candidates(dimension: DataFrame, stored: DataFrame, limit: int = 5000) -> DataFrame:
    """All known addresses of either table, the busiest first, those never seen last."""
    both = dimension.select(F.col("client_ip").alias("ip"), F.col("request_count").alias("n"), "last_seen").unionByName(
        stored.select("ip", F.lit(0).cast("long").alias("n"), F.lit(None).cast(dimension.schema["last_seen"].dataType).alias("last_seen"))
    )
    return both.groupBy("ip").agg(
        F.sum("n").alias("requests"), F.max("last_seen").alias("last_seen"),
    ).orderBy(F.desc("requests"), F.desc_nulls_last("last_seen"), "ip").limit(limit)
