"""Region dimension tables and labelled voxel volumes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthline.operators.ordered import range_block
from depthline.operators.relational import remap_regions
from depthline.operators.sequence import occurrences, transition_counts
from depthline.operators.spatial import relabel_below_surface

# The region given to voids inside the skull.
VOID_FLUID = {
    "id": 2000,
    "name": "void_fluid",
    "acronym": "void_fluid",
    "rgb": [100, 40, 40],
    "level": 0,
    "parent": None,
}


def add_region(regions: DataFrame, region_map: DataFrame, new: dict) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """Append a region for both sides (id and -id) and map it to itself.

    Returns the regions, the mappings and the positions of the new pair.
    A mapping without negative targets sends both sides to the first of them.
    """
    if not regions.filter(F.col("id") == new["id"]).isEmpty():
        raise ValueError(f"region {new['id']} exists")
    size, order = regions.agg(F.count(F.lit(1)), F.max("ord")).first()
    values = {**new, "ord": (order or 0) + 1}

    def row(sign: int):
        fields = {**values, "id": sign * new["id"]}
        return F.struct(*[F.lit(fields.get(f.name)).cast(f.dataType).alias(f.name) for f in regions.schema.fields])

    added = regions.sparkSession.range(1).select(F.inline(F.array(row(1), row(-1))))
    sided = region_map.groupBy("mapping").agg(F.max(F.col("target_id") < 0).alias("sided"))
    new_id = F.lit(new["id"]).cast("long")
    mapped = sided.select(
        F.explode(F.array(new_id, -new_id)).alias("source_id"), "mapping", "sided"
    ).select("source_id", "mapping", F.when(F.col("sided"), F.col("source_id")).otherwise(new_id).alias("target_id"))
    return regions.unionByName(added), region_map.unionByName(mapped.select(region_map.columns)), (size, size + 1)


def assign_voids(volume: DataFrame, surface: DataFrame, new_label: int) -> DataFrame:
    """Label-0 voxels at or past the hull of their `(ap, ml)` column take the new label."""
    return relabel_below_surface(volume, surface, ["ap", "ml"], "dv", "hull_dv", "label", 0, new_label)


def region_transitions(
    volume: DataFrame,
    region_map: DataFrame,
    regions: DataFrame,
    mapping: str = "Cosmos",
    mask: str | None = None,
    slab: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """`(counts, occurrences)` of vertically adjacent regions of a hierarchy level."""
    mapped = remap_regions(volume, region_map, regions, mapping, "label", "region")
    valid = F.col("region_id").isNotNull() if mask is None else (F.col("region_id").isNotNull() & F.col(mask))
    counts = transition_counts(mapped, ["ap", "ml"], ["dv"], "region_id", range_block("dv", slab), valid)
    return counts, occurrences(counts)


def region_ids(region_map: DataFrame, mapping: str) -> Sequence[int]:
    """Sorted ids of a hierarchy level (a short list)."""
    rows = region_map.filter(F.col("mapping") == mapping).select("target_id").distinct().collect()
    return sorted(r[0] for r in rows)
