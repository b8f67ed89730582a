"""Home carousel: listings, masters and film frames mixed in a seeded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.operators.masters import master_images

MASTER_SLIDES, CINEMA_SLIDES = 6, 4


def seeded(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("id")))


def carousel_mix(exhibitions: DataFrame, masters: DataFrame, scenes: DataFrame, seed: int) -> DataFrame:
    """(kind, id, label, image, face). Masters and scenes without an image are out; any seeded order is valid."""
    none = F.lit(None).cast("string")
    shows = exhibitions.select(
        F.lit("exhibition").alias("kind"), "id", F.col("title").alias("label"),
        F.col("poster_image_url").alias("image"), none.alias("face"),
    )
    people = (
        master_images(masters)
        .filter(F.coalesce("hero", F.lit("")) != "")
        .orderBy(seeded(seed), "id")
        .limit(MASTER_SLIDES)
        .select(F.lit("master").alias("kind"), "id", F.col("name").alias("label"), F.col("hero").alias("image"), "face")
    )
    frames = (
        scenes.filter(F.coalesce("image", F.lit("")) != "")
        .orderBy(seeded(seed), "id")
        .limit(CINEMA_SLIDES)
        .select(
            F.lit("cinema").alias("kind"), "id", F.try_element_at("title", F.lit("en")).alias("label"), "image",
            none.alias("face"),
        )
    )
    return shows.unionByName(people).unionByName(frames).orderBy(seeded(seed), "id")
