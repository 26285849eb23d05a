"""Entities out of harvested points of interest, and query templates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import entity_id

#: Tags of closed places, kinds that are a cuisine of their own, and words that name nothing alone.
CLOSED_TAGS = ("disused", "abandoned", "was:amenity", "disused:amenity")
OWN_KINDS = ("cafe", "bakery", "bar", "meal_takeaway", "meal_delivery")
STOPWORDS = frozenset({"the", "a", "an", "and", "of"})


def _present(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def osm_entities(elements: DataFrame, default_city: Column) -> DataFrame:
    """Open, named, placed elements as entities. elements: type, lat, lon, center struct<lat, lon>, tags map."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    name = F.trim(F.coalesce(tag("name"), F.lit("")))
    node = F.col("type") == "node"
    lat, lng = F.when(node, F.col("lat")).otherwise(F.col("center.lat")), F.when(node, F.col("lon")).otherwise(F.col("center.lon"))
    closed = F.lit(False)
    for k in CLOSED_TAGS:
        closed = closed | _present(tag(k))
    city = F.coalesce(F.nullif(F.trim(F.coalesce(tag("addr:city"), F.lit(""))), F.lit("")), default_city)
    cuisine = F.filter(F.transform(F.split(F.coalesce(tag("cuisine"), F.lit("")), ";"), lambda c: F.lower(F.trim(c))), lambda c: c != "")
    out = elements.where((name != "") & ~closed & lat.isNotNull() & lng.isNotNull())
    chain = _present(tag("brand")) | _present(tag("brand:wikidata"))
    return out.select(entity_id(name, city).alias("entity_id"), name.alias("name"), city.alias("city"), F.lit("osm").alias("source"), chain.alias("is_chain"), lat.alias("lat"), lng.alias("lng"), cuisine.alias("cuisine"))


def places_entities(places: DataFrame, default_city: Column, min_ratings: int = 0) -> DataFrame:
    """Named, operating, rated places as entities; one row per region and place id, null ids all stay.

    places: region, id, name, status, ratings, kind, components array<struct<text, types>>, lat, lng.
    """
    name = F.trim(F.coalesce("name", F.lit("")))
    locality = F.get(F.filter("components", lambda c: F.array_contains(c["types"], "locality")), F.lit(0))["text"]
    city = F.coalesce(F.nullif(locality, F.lit("")), default_city)
    kind = F.coalesce("kind", F.lit(""))
    cuisine = F.when(F.endswith(kind, F.lit("_restaurant")), F.array(F.regexp_replace(kind, "_restaurant$", ""))).when(kind.isin(*OWN_KINDS), F.array(kind)).otherwise(F.array().cast("array<string>"))
    operating = F.col("status").isNull() | (F.col("status") == "OPERATIONAL")
    out = places.where((name != "") & operating & (F.coalesce("ratings", F.lit(0)) >= min_ratings))
    out = out.where("id is not null").dropDuplicates(["region", "id"]).unionByName(out.where("id is null"))
    return out.select(entity_id(name, city).alias("entity_id"), name.alias("name"), city.alias("city"), F.lit("places").alias("source"), F.lit(False).alias("is_chain"), "lat", "lng", cuisine.alias("cuisine"))


def _key(token: str) -> str:
    return re.sub("[^a-z0-9]", "", token.lower())


def _marked(words: list[str], phrase: list[str], mark: str, partial: bool) -> list[str]:
    """Words with each mention of a phrase as one mark, mentions side by side as one.

    At each word the longest stretch of the phrase that the words follow is a mention if it is the whole phrase or, for
    partial ones, has two words or is the phrase's first telling word.
    """
    telling = next((p for p in phrase if p not in STOPWORDS), None)
    keys, out, at = [_key(w) for w in words], [], 0
    stretches = sorted({tuple(phrase[a:b]) for a in range(len(phrase)) for b in range(a + 1, len(phrase) + 1)}, key=len, reverse=True)
    while at < len(words):
        run = next((s for s in stretches if tuple(keys[at : at + len(s)]) == s), ())
        if run and (len(run) == len(phrase) or partial and (len(run) > 1 or run[0] == telling)):
            out += [mark] * (out[-1:] != [mark])
            at += len(run)
        else:
            out.append(words[at])
            at += 1
    return out


def template_of(query: str, name: str, city: str) -> str:
    """A query with mentions of name (also in part) and city (whole) as placeholders; the name goes first."""
    words = query.lower().split()
    for phrase, mark, partial in ((name, "{name}", True), (city, "{city}", False)):
        words = _marked(words, [k for k in map(_key, phrase.split()) if k], mark, partial)
    return " ".join(words)


@F.pandas_udf(T.StringType())
def templatize(query: pd.Series, name: pd.Series, city: pd.Series) -> pd.Series:
    return pd.Series([None if q is None else template_of(q, n or "", c or "") for q, n, c in zip(query, name, city)], dtype=object)
