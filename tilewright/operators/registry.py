"""Registries of tiles: joins with lists, tags, splits and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_filtering(tiles: DataFrame, listed: DataFrame, key: str = "tile_id") -> DataFrame:
    """Tiles with the flags of a filtered list; tiles that it lacks are invalid and all flags false."""
    j = tiles.join(listed.select(key, F.lit(True).alias("is_valid"), "rgb_valid", "has_targets"), key, "left")
    return j.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_valid", "rgb_valid", "has_targets")})


def selected(registry: DataFrame, valid: bool | None = None, split: str | None = None) -> DataFrame:
    """Filter by validity (null counts as false) and split."""
    if valid is not None:
        registry = registry.filter(F.coalesce("is_valid", F.lit(False)) == valid)
    return registry if split is None else registry.filter(F.col("split") == split)


def of_illumination(tiles: DataFrame, kind: str | None, background_passes: bool = False) -> DataFrame:
    """Tiles of one illumination; anything but sun and shadow keeps all. A missing tag never matches; background rows may pass."""
    if kind not in ("sun", "shadow"):
        return tiles
    ok = F.coalesce(F.col("illumination") == kind, F.lit(False))
    return tiles.filter(ok | (F.coalesce(F.col("role"), F.lit("")) == "background") if background_passes else ok)


def inside(tiles: DataFrame) -> DataFrame:
    return tiles.filter(F.col("inside_boundary").eqNullSafe(True))


def paired_layers(features: DataFrame, targets: DataFrame, key: str = "tile_id") -> tuple[DataFrame, int]:
    """Tiles with features and target, and the number of feature tiles in all."""
    return features.join(targets, key), features.count()


def excluded(all_ids: DataFrame, valid: DataFrame, key: str = "tile_id") -> DataFrame:
    return all_ids.join(valid.select(key).distinct(), key, "left_anti")


def tagged(tiles: DataFrame, tags: DataFrame, key: str = "tile_id") -> tuple[DataFrame, DataFrame]:
    """Tiles with their tag, and the tag counts."""
    t = tiles.join(tags, key, "left")
    return t, t.groupBy("illumination").agg(F.count("*").alias("n"))


def upserted_metrics(old: DataFrame, new: DataFrame, tiles: DataFrame) -> DataFrame:
    """Per-tile metrics of runs: new rows of known tiles replace old ones of the same tile and run; missing values are 0."""
    fresh = new.join(tiles.select("tile_id"), "tile_id", "left_semi").fillna(0.0)
    return old.join(fresh, ["tile_id", "run_id"], "left_anti").unionByName(fresh)


def train_usage(registry: DataFrame, background: DataFrame, key: str = "tile_id") -> DataFrame:
    """background before validity before split."""
    j = registry.join(background.select(key, F.lit(True).alias("_bg")).distinct(), key, "left")
    usage = F.when(F.col("_bg"), "background").when(~F.coalesce("is_valid", F.lit(False)), "excluded").otherwise(F.coalesce("split", F.lit("unused")))
    return j.withColumn("train_usage", usage).drop("_bg")


def representatives(tiles: DataFrame, wanted: list, number: Column, key: str = "tile_id") -> DataFrame:
    """Tiles named by index (the digits after the last underscore) or by id."""
    ints = [int(w) for w in wanted if isinstance(w, int)]
    texts = [w for w in wanted if isinstance(w, str)]
    return tiles.filter(number.isin(ints) | F.col(key).isin(texts))


def rewritten_paths(tiles: DataFrame, old: str, new: str, column: str = "targets_path") -> tuple[DataFrame, DataFrame]:
    """Paths with ``old`` replaced, and the number of changes."""
    has = F.col(column).contains(old)
    changed = tiles.agg(F.count_if(has).alias("changed"))
    return tiles.withColumn(column, F.when(has, F.replace(F.col(column), F.lit(old), F.lit(new))).otherwise(F.col(column))), changed


def channels(layers: DataFrame) -> DataFrame:
    """Offsets of enabled layers in order: ord, name, bands, offset. No enabled layer is an error."""
    from pyspark.sql import Window

    on = layers.filter("enabled")
    if on.isEmpty():
        raise ValueError("no layer is enabled")
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)  # a handful of layers
    return on.withColumn("offset", F.coalesce(F.sum("bands").over(w), F.lit(0)).cast("int")).select("ord", "name", "bands", "offset")


def assembled(tile_cells: DataFrame, layers: DataFrame) -> DataFrame:
    """Cells (tile_idx, layer, band, r, c, value) with their channel. A tile that lacks an enabled layer is an error naming both."""
    ch = channels(layers)
    names = [r["name"] for r in ch.collect()]
    have = tile_cells.groupBy("tile_idx").agg(F.collect_set("layer").alias("has"))
    lost = have.select("tile_idx", F.explode(F.array_except(F.array(*[F.lit(n) for n in names]), "has")).alias("name")).first()
    if lost:
        raise ValueError(f"tile {lost['tile_idx']} lacks layer {lost['name']}")
    return tile_cells.join(F.broadcast(ch), tile_cells["layer"] == ch["name"]).withColumn("channel", F.col("offset") + F.col("band") - 1).drop("ord", "name", "bands", "offset")
