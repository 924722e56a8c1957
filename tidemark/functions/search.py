"""The search language of the event views, compiled to a Column.

``a b or field:value`` is an OR of ANDs: quoted phrases, plain words, ``field:value`` with ``*`` wildcards,
``status:>=400`` and ``severity:``. A field term also matches where it stands literally in the row's text.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns behind a field's name.
ALIASES = {
    "agent": ("user_agent", "sample", "family", "known_actor", "actor_type"), "ua": ("user_agent", "sample", "family", "known_actor", "actor_type"),
    "browser": ("user_agent", "sample", "family"), "env": ("env", "environment"), "host": ("site_id", "host"), "ip": ("client_ip", "ip", "source_ip"),
    "method": ("method",), "path": ("path",), "project": ("site_id", "project", "site"), "site": ("site_id", "project", "site"),
}


def parse(query: str) -> list[list[tuple[str, str]]]:
    """Groups of (field, value); the field of a plain word is ''."""
    groups = []
    for part in re.split(r"\s+or\s+", query, flags=re.I):
        terms = []
        for double, single, bare in re.findall(r"\"([^\"]+)\"|'([^']+)'|(\S+)", part):
            token = double or single or bare
            named = re.fullmatch(r"([a-z_][a-z0-9_-]*):(.*)", token, re.I | re.S)
            field, value = (named[1].lower(), named[2].lower()) if named else ("", token.lower())
            if value:
                terms.append((field, value))
        if terms:
            groups.append(terms)
    return groups


def _status(column: Column, value: str) -> Column:
    test = re.fullmatch(r"(>=|<=|>|<|=)?(\d+)", value)
    if not test:
        return F.coalesce(column.cast("string"), F.lit("")).contains(value)
    n = F.lit(int(test[2]))
    return {">=": column >= n, "<=": column <= n, ">": column > n, "<": column < n}.get(test[1], column == n)


def _wildcard(column: Column, value: str) -> Column:
    text = F.lower(column.cast("string"))
    return text.rlike("(?s)^" + ".*".join(map(re.escape, value.split("*"))) + "$") if "*" in value else text.contains(value)


def condition(events: DataFrame, query: str) -> Column:
    """Whether a row matches; an empty query matches every row."""
    names = set(events.columns)
    text = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in events.columns)))

    def term(field: str, value: str) -> Column:
        if not field:
            return text.contains(value)
        if field == "status" and "status" in names:
            hit = _status(F.col("status"), value)
        elif field == "severity":
            code = F.col("status") if "status" in names else F.lit(None).cast("int")
            said = F.lower(F.col("severity")) if "severity" in names else F.lit("")
            hit = F.when(F.coalesce(said, F.lit("")) != "", said).when(code >= 500, "critical error 5xx").when(code >= 400, "high warning error 4xx").otherwise("info ok").contains(value)
        else:
            hits = [_wildcard(F.col(c), value) for c in ALIASES.get(field, (field,)) if c in names]
            hit = reduce(or_, (F.coalesce(h, F.lit(False)) for h in hits)) if hits else F.lit(False)
        return F.coalesce(hit, F.lit(False)) | text.contains(f"{field}:{value}")

    groups = parse(query)
    return reduce(or_, (reduce(and_, (term(*t) for t in g)) for g in groups)) if groups else F.lit(True)


def search(events: DataFrame, query: str) -> DataFrame:
    return events.where(condition(events, query))
