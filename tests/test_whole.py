"""Registered queries over whole tables."""

from edgeproof.plans import registry, registry_more


def test_colours_of_every_part(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    assert parts > 40 and registry.QUERIES["colour_simulated"](spark, sf).count() == parts


def test_palette_check_takes_the_fixed_palette(spark):
    """No table is read: the pairs are those of the stated palette."""
    got = registry.QUERIES["colour_palette_check"](spark, "/nowhere").collect()
    assert got and len(registry_more.PALETTE) == 8
