"""schema.org JSON-LD: scripts taken apart into nodes, nodes read as VARIANT values."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .hours import compact_hours, day_name
from .names import one_each
from .text import filled, let, stripped, words

ADDRESS = "struct<locality:string,region:string,country:string,raw:string>"


def at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']", "variant")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def is_object(v: Column) -> Column:
    return _kind(v).startswith("OBJECT")


def string_of(v: Column) -> Column:
    """The string that the value is; null for anything else."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def text_of(v: Column) -> Column:
    """The value as text, falsy ones missing."""
    text = F.try_variant_get(v, "$", "string")
    return F.when(_kind(v).isin("VOID", "BOOLEAN") & (F.coalesce(text, F.lit("false")) == "false"), F.lit(None)).otherwise(F.nullif(filled(text), F.lit("0")))


def items(v: Column) -> Column:
    """A list's elements; a single value as a list of one; nothing for null."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(_kind(v) != "VOID", F.array(v)), F.expr("cast(array() as array<variant>)"))


def node_texts(script: str) -> list[str]:
    """The objects of a script body as JSON, each before those of its ``@graph``, lists flattened to any depth.

    A malformed body gives none; of repeated keys the last counts; what is no number is null.
    """
    try:
        left = [json.loads(script, parse_constant=lambda _: None)]
    except (ValueError, RecursionError):
        return []
    found = []
    while left:
        x = left.pop()
        if isinstance(x, list):
            left += reversed(x)
        elif isinstance(x, dict):
            found.append(json.dumps({k: v for k, v in x.items() if k != "@graph"}, ensure_ascii=False))
            left.append(x.get("@graph"))
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def unwrapped(scripts: pd.Series) -> pd.Series:
    """The objects of several script bodies, see :func:`node_texts`.  The page parser takes them apart itself."""
    return pd.Series([[n for s in (some if some is not None else ()) for n in node_texts(s or "")] for some in scripts], dtype=object)


def nodes(texts: Column) -> Column:
    """Nodes out of their JSON texts."""
    return F.filter(F.transform(texts, F.try_parse_json), lambda n: n.isNotNull())


def types(node: Column) -> Column:
    return F.transform(items(at(node, "@type")), lambda t: F.lower(F.try_variant_get(t, "$", "string")))


def is_business(node: Column) -> Column:
    return F.coalesce(F.arrays_overlap(types(node), words(fixed.BUSINESS_TYPES)), F.lit(False))


def country_text(v: Column) -> Column:
    """A string, or the name of a country object."""
    return F.coalesce(string_of(v), F.when(is_object(v), string_of(at(v, "name"))))


def address_parts(v: Column) -> Column:
    """Locality, region, country and the whole as one line."""
    none = F.lit(None).cast("string")
    country = filled(country_text(at(v, "addressCountry")))
    line = F.concat_ws(", ", *(text_of(at(v, k)) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode")), country)
    pack = lambda loc, reg, cou, raw: F.struct(loc.alias("locality"), reg.alias("region"), cou.alias("country"), raw.alias("raw"))
    return (
        F.when(is_object(v), pack(text_of(at(v, "addressLocality")), text_of(at(v, "addressRegion")), country, filled(line)))
        .when(_kind(v) == "STRING", pack(none, none, none, filled(string_of(v))))
        .otherwise(pack(none, none, none, none))
    )


def hours_spec(v: Column) -> Column:
    """Texts of an openingHoursSpecification: strings by the compact form, objects with days, opening and closing time."""

    def one(x: Column) -> Column:
        days = F.array_join(F.transform(items(at(x, "dayOfWeek")), lambda d: day_name(F.try_variant_get(d, "$", "string"))), ", ")
        opens, closes = text_of(at(x, "opens")), text_of(at(x, "closes"))
        whole = F.when((days != "") & opens.isNotNull() & closes.isNotNull(), F.concat(days, F.lit(": "), opens, F.lit("–"), closes))
        return F.when(_kind(x) == "STRING", compact_hours(string_of(x))).when(is_object(x), whole)

    return F.filter(F.transform(items(v), one), lambda s: s.isNotNull() & (s != ""))


def _person(node: Column, any_type: bool) -> Column:
    name = filled(stripped(string_of(at(node, "name"))))
    typed = F.array_contains(types(node), "person")
    role = F.when(typed, filled(stripped(string_of(at(node, "jobTitle")))))
    return F.when(name.isNotNull() & (F.lit(True) if any_type else F.coalesce(typed, F.lit(False))), F.struct(name.alias("name"), role.alias("role")))


def node_people(node: Column) -> Column:
    """People a node names, in order: staff, contact points, itself."""
    staff = F.flatten(F.array(*(F.transform(F.filter(items(at(node, k)), is_object), lambda p: _person(p, True)) for k in fixed.PEOPLE_KEYS)))
    contact_name = lambda p: filled(stripped(string_of(at(p, "name"))))
    points = F.transform(F.filter(items(at(node, "contactPoint")), is_object), lambda p: F.when(contact_name(p).isNotNull(), F.struct(contact_name(p).alias("name"), F.lit(None).cast("string").alias("role"))))
    none = F.expr("cast(array() as array<struct<name:string,role:string>>)")
    found = F.concat(F.when(is_business(node), F.concat(staff, points)).otherwise(none), F.array(_person(node, False)))
    return F.filter(found, lambda p: p.isNotNull())


def node_phones(node: Column) -> Column:
    own = F.array(filled(stripped(string_of(at(node, "telephone")))))
    points = F.transform(F.filter(items(at(node, "contactPoint")), is_object), lambda p: filled(stripped(string_of(at(p, "telephone")))))
    return F.filter(F.concat(own, F.when(is_business(node), points).otherwise(F.expr("cast(array() as array<string>)"))), lambda p: p.isNotNull())


def node_hours(node: Column) -> Column:
    simple = F.transform(F.filter(items(at(node, "openingHours")), lambda x: _kind(x) == "STRING"), lambda x: compact_hours(string_of(x)))
    return F.when(is_business(node), F.concat(hours_spec(at(node, "openingHoursSpecification")), simple)).otherwise(F.expr("cast(array() as array<string>)"))


def people(all_nodes: Column) -> Column:
    """People by exact name: first position, first role given."""
    return one_each(F.flatten(F.transform(all_nodes, node_people)))


def first_address(all_nodes: Column) -> Column:
    """The first business address with a line; else the last one looked at."""
    found = F.transform(F.filter(all_nodes, lambda n: is_business(n) & (_kind(at(n, "address")) != "VOID")), lambda n: address_parts(at(n, "address")))
    return let(found, lambda xs: F.coalesce(F.get(F.filter(xs, lambda x: x["raw"].isNotNull()), 0), F.get(xs, F.size(xs) - 1)))


def summary(all_nodes: Column) -> Column:
    """phones, names, hours, address of the nodes of a site."""
    return let(
        all_nodes,
        lambda ns: F.struct(
            F.array_distinct(F.flatten(F.transform(ns, node_phones))).alias("phones"),
            people(ns).alias("names"),
            F.array_distinct(F.flatten(F.transform(ns, node_hours))).alias("hours"),
            first_address(ns).alias("address"),
        ),
    )
