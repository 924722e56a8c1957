"""Who is behind an address: trust, risk and labels, as Columns over IP-intelligence rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.catalog import by_network_org, by_reverse_dns

#: Actor types that prove nothing, and those of rented machines.
UNTRUSTED = ("cloud", "datacenter", "edge", "hosting", "vps", "unknown", "tor", "")
INFRASTRUCTURE = ("cloud", "datacenter", "edge", "hosting", "vps")


def _text(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def verified_source(known_actor: Column, actor_type: Column, manual_action: Column, forward_confirmed: Column, verified_actor: Column) -> Column:
    """The strict rule: what a person decided, else a trusted type that is verified or confirmed by DNS."""
    action, actor = _text(manual_action), _text(known_actor)
    proven = _true(verified_actor) | (_true(forward_confirmed) & ~actor.isin("", "tor exit"))
    return F.when(action == "suspicious", False).when(action.isin("allowlisted", "verified"), True).when(_text(actor_type).isin(*UNTRUSTED), False).otherwise(proven)


def verified_source_loose(known_actor: Column, actor_type: Column, manual_action: Column, forward_confirmed: Column, verified_actor: Column) -> Column:
    """The rule of the user-agent report: fewer types are ruled out, and 'Tor exit' is an actor like others."""
    action = F.coalesce(manual_action, F.lit(""))
    proven = _true(verified_actor) | (_true(forward_confirmed) & (F.coalesce(known_actor, F.lit("")) != ""))
    return F.when(action == "suspicious", False).when(action.isin("allowlisted", "verified"), True).otherwise(
        ~F.coalesce(actor_type, F.lit("")).isin("", "datacenter", "unknown", "tor") & proven
    )


def classify_reverse_dns(names: Column, requests: Column) -> Column:
    """(actor_type, known_actor, risk_score) by the first host name that a service claims, else by volume."""
    hit = F.get(F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), by_reverse_dns), lambda x: x.isNotNull()), F.lit(0))
    volume = F.when(requests >= 10000, 65).when(requests >= 1000, 50).when(requests >= 100, 35).otherwise(20)
    return F.struct(
        F.coalesce(hit["actor_type"], F.lit("unknown")).alias("actor_type"), F.coalesce(hit["known_actor"], F.lit("")).alias("known_actor"),
        F.coalesce(hit["risk_score"], volume).cast("int").alias("risk_score"),
    )


def is_infrastructure(actor_type: Column) -> Column:
    return _text(actor_type).isin(*INFRASTRUCTURE)


def provider_baseline(actor_type: Column) -> Column:
    return F.when(_text(actor_type).isin("cloud", "datacenter"), 55).when(_text(actor_type) == "edge", 45).otherwise(25)


def traffic_risk(risk: Column, requests: Column, status_4xx: Column, status_5xx: Column, rented: Column) -> Column:
    """At least 85 for rented machines of which 80 % or more of 50 or more answers are errors."""
    bad = status_4xx + status_5xx
    return F.when((requests > 0) & (bad >= 50) & (bad / requests >= 0.80) & _true(rented), F.greatest(risk, F.lit(85))).otherwise(risk)


def network_org(actor_type: Column, known_actor: Column, risk: Column, org: Column, is_tor: Column) -> Column:
    """The organisation's service in place of what is known so far, except for Tor exits."""
    service = F.when(~_true(is_tor), by_network_org(org))
    return F.struct(
        F.coalesce(service["actor_type"], actor_type).alias("actor_type"), F.coalesce(service["known_actor"], known_actor).alias("known_actor"),
        F.coalesce(service["risk_score"], risk).alias("risk_score"),
    )


def suspicious_ip(manual_action: Column, actor_type: Column, known_actor: Column, is_tor_exit: Column, category: Column, rented: Column, requests: Column, status_4xx: Column, status_5xx: Column, risk: Column) -> Column:
    bad = F.coalesce(status_4xx, F.lit(0)) + F.coalesce(status_5xx, F.lit(0))
    infra = is_infrastructure(actor_type) | _true(rented)
    return (
        _text(manual_action).isin("suspicious", "watch")
        | (_text(actor_type) == "tor")
        | (_text(known_actor) == "tor exit")
        | _true(is_tor_exit)
        | _text(category).rlike("sql|xss|injection|traversal|secret_file|admin_tool|admin_path|admin_login|credential|scanner|probe")
        | (infra & (requests >= 100) & (bad >= 50) & (bad / requests >= 0.80))
        | (F.coalesce(risk, F.lit(0)) >= 70)
    )


def manual_action(action: str, label: Column, risk: Column) -> tuple[Column, Column, Column]:
    """(manual_action, manual_label, risk_score) after a person's decision: white space in labels collapsed,
    160 characters at most; suspicious raises the risk to 80, verified and allowlisted lower it to 10."""
    if action not in ("verified", "allowlisted", "suspicious", "watch", "ignored", "clear"):
        raise ValueError(f"unknown action {action!r}")
    if action == "clear":
        return F.lit(None).cast("string"), F.lit(None).cast("string"), risk
    clean = F.left(F.trim(F.regexp_replace(label, r"\s+", " ")), F.lit(160))
    changed = F.greatest(F.coalesce(risk, F.lit(0)), F.lit(80)) if action == "suspicious" else F.least(F.coalesce(risk, F.lit(10)), F.lit(10)) if action in ("verified", "allowlisted") else risk
    return F.lit(action), clean, changed
