"""The item catalogue: one row an id, with the defaults each consumer expects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.text import clean_text

#: what a genre column of the raw catalogue says when there is none: fixed value
NO_GENRES = "(no genres listed)"


def from_movies(movies: DataFrame) -> DataFrame:
    """(item_id, title, main_cat, category, genres) from (movieId, title, genres as a pipe list)."""
    parts = F.filter(F.transform(F.split(F.coalesce("genres", F.lit("")), r"\|"), F.trim), lambda g: (g != "") & (g != NO_GENRES))
    title = F.coalesce(F.nullif(clean_text(F.col("title")), F.lit("")), F.concat(F.lit("Movie "), F.col("movieId")))
    first = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("Unknown"))
    return movies.select(F.col("movieId").cast("string").alias("item_id"), title.alias("title"), first.alias("main_cat"), F.array_join(parts, " > ").alias("category"), parts.alias("genres"))


def one_per_id(items: DataFrame) -> DataFrame:
    """Repeated rows of an id as one: of each text the smallest clean spelling, of genres the longest list, then the smallest."""
    text = lambda c: F.min(F.nullif(clean_text(F.col(c)), F.lit(""))).alias(c)
    genres = F.transform(F.coalesce("genres", F.array().cast("array<string>")), clean_text)
    genres = F.filter(genres, lambda g: g != "")
    best = F.min(F.struct(F.negative(F.size(genres)).alias("s"), genres.alias("g")))
    grouped = items.filter("item_id is not null").groupBy(F.col("item_id").cast("string").alias("item_id"))
    return grouped.agg(text("title"), text("main_cat"), text("category"), best.alias("b")).select("item_id", "title", "main_cat", "category", F.col("b.g").alias("genres"))


def item_info(items: DataFrame, variant: str = "extraction") -> DataFrame:
    """(item_id, item_name, item_category). Variants differ in defaults and in how many genres stand in for a category:
    extraction takes all, inference the first five, flat the first three and another missing title."""
    take = {"extraction": None, "inference": 5, "flat": 3}[variant]
    genres = F.col("genres") if take is None else F.slice("genres", 1, take)
    missing = "Unknown Item " if variant == "flat" else "Item "
    category = F.coalesce("main_cat", "category", F.nullif(F.array_join(genres, " > "), F.lit("")), F.lit("Unknown"))
    return one_per_id(items).select("item_id", F.coalesce("title", F.concat(F.lit(missing), "item_id")).alias("item_name"), category.alias("item_category"))


def catalogue_id(*columns: Column) -> Column:
    """The id of a catalogue row, from whichever of its possible columns holds one first."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])
