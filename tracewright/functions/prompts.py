"""System prompts by variant and restrictions, built once for each distinct pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIANTS = ("student", "teacher")
BASE = "Find the current menu of the named restaurant and answer with one JSON object."
RULES = "Use only what the tools returned. If there is no menu, answer with found set to false."
GUIDANCE = "Prefer the restaurant's own site to delivery services and aggregators."


def system_prompt(restrictions: Column, variant: str = "student") -> Column:
    """Task, scope, restrictions if any, rules, and for the teacher guidance on sources."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown prompt variant {variant!r}")
    asked = F.coalesce(F.array_join(restrictions, "; "), F.lit(""))
    scope = F.when(asked == "", F.lit("List the whole menu.")).otherwise(F.concat(F.lit("List only items fit for: "), asked, F.lit(".")))
    return F.concat_ws("\n\n", F.lit(BASE), scope, F.lit(RULES), *([F.lit(GUIDANCE)] if variant == "teacher" else []))


def with_prompts(episodes: DataFrame, restrictions: str, variant: str = "student") -> DataFrame:
    """``episodes`` with their system prompt."""
    return episodes.withColumn("system_prompt", system_prompt(F.col(restrictions), variant))
