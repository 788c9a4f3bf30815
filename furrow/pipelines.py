"""The two compositions of operators: the gap report over a flight, and the live session."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import gates, geometry
from furrow.operators import folds, fusion, records, rows, spatial, statistics, sync
from furrow import storage
from furrow.storage import checkpointed
from furrow.streaming import stateful


@dataclass(frozen=True)
class GapSettings:
    confidence: float = 0.25
    overlap: float = 0.5
    close: float = 8.0
    #: None takes the radius from the spacing of neighbours in sampled frames and from ``reprojection``.
    association: float | None = 8.0
    reprojection: float = 0.0
    merge: float = 0.75
    max_gap: int = 3
    confirmed: int = 2
    suspicious: int = 3
    tolerance: float = 0.42
    least_plants: int = 40
    least_in_row: int = 5
    band: float = 0.42
    boundary: float = 2.5
    least_coverage: int = 3
    cell: float = 100.0
    image: tuple[float, float] = (3840.0, 2160.0)


def gap_report(detections: DataFrame, transforms: DataFrame, areas: DataFrame, settings: GapSettings | None = None, fit: DataFrame | None = None) -> dict[str, DataFrame]:
    """Detections to unique plants, rows, expected, missing and rejected places, gaps and a summary of each plot.

    ``detections``: frame_index, class_id, confidence, x1..y2, detection_id. ``transforms``, one row for each processed frame: frame_index, segment_id, matrix
    (frame to local), inverse and footprint x0, y0, x1, y1 (local). ``areas``: area_id (its order: of areas that share a plant the
    last names it), part, hole, xs, ys (local). ``fit``, if there, has for some plots the similarity to the ground: plot_id, a, b, shift_x, shift_y, lat0, lon0, geo_valid, geo_method,
    geo_quality, horizontal_uncertainty_m; gaps and plants of other plots, and of those without a valid one, have no latitude and longitude.

    Plants of a plot are the confirmed ones and those of low support. Rows are cut where the way from a plant to the next leaves the plot; slots
    outside it are dropped. A slot without a plant is a candidate, rejected near the plot's border or where too few frames could see
    it, and worth half near a suspicious sighting.

    ``summary`` has a row for each plot with what went into each step and came out; ``totals`` is their sum in one row.
    """
    s = settings or GapSettings()
    kept = folds.suppress_close_centers(folds.suppress_overlaps(detections.where(gates.confident(F.col("confidence"), s.confidence)), s.overlap), s.close)
    local = fusion.to_local(kept, transforms).join(transforms.select("frame_index", "segment_id"), "frame_index")
    observed = local.select("segment_id", "frame_index", (F.shiftleft(F.col("frame_index").cast("long"), 31) + F.col("detection_id")).alias("observation_id"), F.col("local_x").alias("x"), F.col("local_y").alias("y"), "confidence")
    observed = checkpointed(observed)
    plants = checkpointed(_unique(observed, transforms, s if s.association is not None else replace(s, association=_radius(observed, s))))
    frames = transforms.select("frame_index", "x0", "y0", "x1", "y1", "inverse")
    seen = fusion.visibility(plants.select("plant_id", "x", "y"), frames, *s.image).select("plant_id", "visibility_opportunity")
    status = gates.support_status(F.col("observation_count"), F.col("visibility_opportunity"), s.confirmed, s.suspicious)
    plants = plants.join(seen, "plant_id").withColumn("support_status", status)
    inside = spatial.points_in_areas(plants.select(F.col("plant_id").alias("id"), "x", "y", "support_status"), areas, s.cell).withColumnRenamed("area_id", "plot_id")
    inside = checkpointed(inside)
    plants = checkpointed(plants.join(inside.groupBy(F.col("id").alias("plant_id")).agg(F.max("plot_id").alias("plot_id")), "plant_id", "left"))
    good = inside.where("support_status in ('confirmed', 'low_support')")
    enough = good.groupBy("plot_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= s.least_plants).select("plot_id")
    chosen = checkpointed(good.join(enough, "plot_id", "left_semi"))

    near = spatial.nearest(chosen, chosen, 15, s.cell / 2, ["plot_id"])
    at = lambda name: chosen.select("plot_id", F.col("id").alias("id" if name == "a" else "other_id"), F.col("x").alias(f"{name}x"), F.col("y").alias(f"{name}y"))
    near = checkpointed(near.join(at("a"), ["plot_id", "id"]).join(at("b"), ["plot_id", "other_id"]).withColumn("degrees", F.degrees(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")))))
    turn = statistics.axial_peak(near.where("rank <= 4 and distance > 0"), ["plot_id"], "degrees", "distance", near=3.0)
    turn = checkpointed(turn.select("plot_id", F.radians("orientation_deg").alias("angle"), F.least(6 * F.col("peak_weight") / F.col("total_weight"), F.lit(1.0)).alias("sureness")))

    def turned(df: DataFrame, x: Column, y: Column) -> DataFrame:
        along, across = geometry.along_across(x, y, F.col("angle"))
        return df.join(turn.select("plot_id", "angle"), "plot_id").withColumn("along", along).withColumn("across", across).drop("angle")

    def placed(df: DataFrame) -> DataFrame:
        x, y = geometry.from_along_across(F.col("along"), F.col("across"), F.col("angle"))
        return df.join(turn.select("plot_id", "angle"), "plot_id").withColumn("x", x).withColumn("y", y).drop("angle")

    normal = near.where("rank = 1").groupBy("plot_id").agg(F.median("distance").alias("spacing"))
    scale = rows.row_distances(turned(near.select("plot_id", "ax", "ay", "bx", "by"), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")), normal, s.least_in_row)
    scale = checkpointed(normal.join(scale, "plot_id"))
    points = turned(chosen, F.col("x"), F.col("y")).select("plot_id", F.col("id").alias("plant_id"), "support_status", "along", "across")
    banded = checkpointed(rows.reconstructed(points, scale, s.least_in_row, s.band))
    lanes, spacing, cuts = _cut(banded, areas, placed, turn, s)
    expected = checkpointed(placed(rows.expected_slots(lanes, spacing)))
    own = spatial.points_in_areas(expected, areas, s.cell).where("area_id = plot_id")
    expected_in = checkpointed(spatial.ring_distances(own, areas).drop("area_id"))
    gap = rows.adjacent_distances(expected_in, ["plot_id", "row_id"], ["slot_index"]).groupBy("plot_id", "row_id").agg(F.coalesce(F.median("step"), F.lit(1.0)).alias("spacing"))
    missing = rows.missing_slots(expected_in, points, gap, s.tolerance)
    hidden = rows.missing_slots(expected_in, points.where("support_status = 'confirmed'"), gap, s.tolerance).join(missing.select("plot_id", "row_id", "slot_index"), ["plot_id", "row_id", "slot_index"], "left_anti")
    missing = checkpointed(missing.join(spacing, ["plot_id", "row_id"]).withColumn("plant_id", F.concat_ws("_", F.col("plot_id").cast("string"), "row_id", F.col("slot_index").cast("string"))))
    missing = checkpointed(fusion.visibility(missing, frames, *s.image).withColumnRenamed("visibility_opportunity", "coverage_count"))
    why = gates.candidate_rejection(F.col("boundary_distance"), s.boundary * F.col("spacing"), F.col("coverage_count"), F.lit(s.least_coverage))
    missing = missing.withColumn("rejection_reason", why)
    candidates = missing
    rejected = missing.where("rejection_reason is not null").withColumn("boundary_fraction", F.col("boundary_distance") / F.greatest("spacing", F.lit(1e-9))).withColumn("candidate_id", F.concat(F.lit("rejected_"), "plant_id"))
    judged = checkpointed(_doubted(missing.where("rejection_reason is null").drop("rejection_reason"), inside.where("support_status = 'suspicious_singleton'"), s))
    found = placed(rows.gaps(judged)).withColumnsRenamed({"x": "local_x", "y": "local_y"}).withColumn("square", geometry.square(F.col("local_x"), F.col("local_y"), 4.0))
    found = records.numbered(found, [F.col("plot_id"), F.col("row_id"), F.col("start_slot")]).withColumn("gap_id", F.format_string("gap_%06d", "number")).drop("number")
    plots = areas.select(F.col("area_id").alias("plot_id")).distinct()
    analysed = good.select("plot_id", F.col("id").alias("plant_id"), "support_status")
    one, status_is = F.count(F.lit(1)), lambda v: F.count_if(F.col("support_status") == v)
    facts = _facts(
        (analysed, {"plants": one, "confirmed_unique_plants": status_is("confirmed"), "low_support_unique_plants": one - status_is("confirmed")}),
        (banded, {"rows": F.countDistinct("row_id")}),
        (lanes, {"row_segments": F.countDistinct("row_id")}),
        (cuts, {"row_segment_cuts": one}),
        (spacing, {"along_row_spacing": F.median("spacing")}),
        (turn, {"orientation_deg": F.first(F.degrees("angle"))}),
        (scale, {"cross_row_spacing": F.first("inter_row")}),
        (expected, {"expected": one}),
        (expected_in, {"expected_capacity": one}),
        (candidates, {"candidates_before_gates": one, "rejected_boundary": F.count_if(F.col("rejection_reason").startswith("polygon")), "rejected_coverage": F.count_if(F.col("rejection_reason").startswith("insufficient"))}),
        (hidden, {"suppressed_by_low_support": one}),
        (judged, {"estimated_missing_plants": one, "downgraded_near_suspicious": F.count_if(F.col("nearby_suspicious_count") > 0)}),
        (found, {"gap_count": one}),
    )
    summary = _summary(plots, facts, s.least_plants)
    if fit is not None:
        found = fusion.georeferenced(found.withColumns({"x": F.col("local_x"), "y": F.col("local_y")}), fit, ["plot_id"], "left").select(*found.columns, *_GEO)
        plants = fusion.georeferenced(plants, fit, ["plot_id"], "left").select(*plants.columns, *_GEO)
    return {"plants": plants, "rows": lanes, "expected": expected_in, "missing": judged, "rejected": rejected, "gaps": found, "summary": summary, "totals": gap_totals(summary)}


_MEASURES = ("along_row_spacing", "orientation_deg", "cross_row_spacing")


def _facts(*parts: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """(plot_id, name, value): figures of plots from several tables, as rows, so that one grouping brings them together."""
    out = []
    for df, figures in parts:
        held = df.groupBy("plot_id").agg(*[v.cast("double").alias(k) for k, v in figures.items()])
        out.append(held.select("plot_id", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in figures])).alias("f")).select("plot_id", "f.*"))
    return reduce(DataFrame.unionByName, out)


def _summary(plots: DataFrame, facts: DataFrame, least: int) -> DataFrame:
    names = [*_SUMS, "plants", "expected", *_MEASURES]
    held = facts.groupBy("plot_id").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names if n not in ("short_fragments_discarded", "rejected_outside")])
    held = plots.select("plot_id").join(held, "plot_id", "left")
    counts = [n for n in held.columns if n not in ("plot_id", *_MEASURES)]
    held = held.withColumns({n: F.coalesce(F.col(n), F.lit(0)).cast("long") for n in counts})
    held = held.withColumns({"short_fragments_discarded": F.col("rows") + F.col("row_segment_cuts") - F.col("row_segments"), "rejected_outside": F.col("expected") - F.col("expected_capacity")})
    rate = F.col("estimated_missing_plants") / F.when(F.col("expected_capacity") > 0, F.col("expected_capacity"))
    status = F.when(F.col("plants") < least, "insufficient_unique_plants").otherwise("complete_candidate_review_required")
    return held.select("plot_id", "plants", *_SUMS, *_MEASURES, rate.alias("missing_rate"), status.alias("analysis_status"))


_GEO = ["latitude", "longitude", "geo_method", "geo_quality", "horizontal_uncertainty_m"]
_SUMS = (
    "rows row_segments row_segment_cuts short_fragments_discarded expected_capacity gap_count estimated_missing_plants candidates_before_gates rejected_outside rejected_boundary rejected_coverage "
    "downgraded_near_suspicious suppressed_by_low_support confirmed_unique_plants low_support_unique_plants"
).split()


def gap_totals(summary: DataFrame) -> DataFrame:
    """One row: the number of plots, of those that were analysed, the sums of all counts, and the missing rate over all plots (null without capacity)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS]
    out = summary.agg(F.count(F.lit(1)).alias("plots"), F.count_if(F.col("analysis_status") != "insufficient_unique_plants").alias("analysed"), *sums)
    return out.withColumn("missing_rate", F.col("estimated_missing_plants") / F.when(F.col("expected_capacity") > 0, F.col("expected_capacity")))


def _radius(observed: DataFrame, s: GapSettings) -> float:
    """The association radius of a flight, one number: from the median distance of neighbours in every 25th frame and the registration's error."""
    every = records.spacing_sample(observed.withColumnRenamed("observation_id", "id"), "segment_id", "frame_index")
    spacing = every.agg(F.median("p50")).first()[0]
    if spacing is None:
        return 4.0
    return observed.sparkSession.range(1).select(fusion.association_radius(F.lit(float(spacing)), F.lit(float(s.reprojection)))).first()[0]


def _unique(observed: DataFrame, transforms: DataFrame, s: GapSettings) -> DataFrame:
    """Observations to plants: tracks, merged where their middles are near and their frames differ; a plant's id is its first observation."""
    tracks = checkpointed(fusion.associate(observed, s.association, s.max_gap, frames=transforms))
    middle = tracks.groupBy("segment_id", "track_id").agg(F.median("x").alias("x"), F.median("y").alias("y"))
    merged = fusion.merged_within(middle, tracks, s.association * s.merge)
    tracks = checkpointed(tracks.join(merged, ["segment_id", "track_id"]))
    first = tracks.groupBy("segment_id", "plant").agg(F.min("observation_id").alias("plant_id"))
    plants = fusion.unique_plants(tracks, ["segment_id", "plant"]).join(first, ["segment_id", "plant"]).drop("plant")
    return plants.withColumn("x", F.col("local_x")).withColumn("y", F.col("local_y"))


def _cut(banded: DataFrame, areas: DataFrame, placed: Callable[[DataFrame], DataFrame], turn: DataFrame, s: GapSettings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows cut at the plot's border as rows of their own (row_id row_segment), their spacing and confidence, and the steps that were cut."""
    points = placed(rows.samples_between(banded).withColumnsRenamed({"x": "along", "y": "across"})).select("plot_id", "row_id", "plant_id", "sample", "x", "y")
    within = spatial.points_in_areas(points, areas, s.cell).where("area_id = plot_id").select("plot_id", "row_id", "plant_id", "sample").withColumn("_in", F.lit(True))
    ok = points.join(within, ["plot_id", "row_id", "plant_id", "sample"], "left").groupBy("plot_id", "row_id", "plant_id").agg(F.min(F.coalesce("_in", F.lit(False))).alias("ok"))
    ok = checkpointed(ok)
    lanes = rows.split_rows(banded, ok, s.least_in_row)
    lanes = checkpointed(lanes.withColumn("row_id", F.concat_ws("_", F.col("row_id").cast("string"), F.col("segment").cast("string"))))
    steps = rows.adjacent_distances(lanes, ["plot_id", "row_id"], ["along", "plant_id"]).where("step > 0")
    many = steps.groupBy("plot_id", "row_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("plot_id", "row_id")
    spacing = statistics.robust_spacing(steps.join(many, ["plot_id", "row_id"], "left_semi"), ["plot_id", "row_id"], "step")
    sure = F.least(F.greatest(0.5 * F.col("sureness") + 0.5 * F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    return lanes, checkpointed(spacing.join(turn.select("plot_id", "sureness"), "plot_id").select("plot_id", "row_id", "spacing", sure.alias("confidence"))), ok.where(~F.col("ok"))


def _doubted(missing: DataFrame, doubtful: DataFrame, s: GapSettings) -> DataFrame:
    """Missing slots with the number of suspicious sightings of their plot within the tolerance, their confidence and reasons."""
    # in units of the plot's widest tolerance, so that each plot's cells have the size that it needs
    unit = missing.groupBy("plot_id").agg((s.tolerance * F.max("spacing")).alias("_u")).where(F.col("_u") > 0)
    scaled = lambda df: df.join(unit, "plot_id").withColumns({"x": F.col("x") / F.col("_u"), "y": F.col("y") / F.col("_u")}).drop("_u")
    pairs = spatial.radius_join(scaled(missing.select("plot_id", F.col("plant_id").alias("id"), "x", "y")), scaled(doubtful.select("plot_id", "id", "x", "y")), 1.000001, ["plot_id"])
    close = pairs.join(missing.select("plot_id", F.col("plant_id").alias("id"), "spacing"), ["plot_id", "id"]).join(unit, "plot_id").where(F.col("distance") * F.col("_u") <= s.tolerance * F.col("spacing"))
    close = close.groupBy("plot_id", F.col("id").alias("plant_id")).agg(F.count(F.lit(1)).alias("nearby_suspicious_count"))
    held = missing.join(close, ["plot_id", "plant_id"], "left").fillna(0, ["nearby_suspicious_count"])
    held = held.withColumn("reasons", gates.slot_reasons(F.col("coverage_count"), F.col("nearby_suspicious_count")))
    return held.withColumn("confidence", gates.downgraded(F.col("confidence"), F.col("nearby_suspicious_count")))


def live_gaps(plants: DataFrame, least: int = 4, band: float = 0.42, tolerance: float = 0.42, usual: float = 30.0) -> dict[str, DataFrame]:
    """The live session's analysis of its plants (session_id, plant_id, x, y), without polygons: ``gaps`` and ``sessions`` with their status.

    The direction is the middle of the fullest bin; rows are chains over the across coordinate; slots stand at whole spacings between a row's ends. Plants
    without a position are left out. A session is a flight, whose plants are few.
    """
    p = plants.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).select("session_id", F.col("plant_id").alias("id"), "x", "y")
    p = checkpointed(p)
    middle = p.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    near = spatial.nearest(p, p, 11, by=["session_id"])
    at = lambda k, name: p.select("session_id", F.col("id").alias(k), F.col("x").alias(f"{name}x"), F.col("y").alias(f"{name}y"))
    near = checkpointed(near.where("distance > 0").join(at("id", "a"), ["session_id", "id"]).join(at("other_id", "b"), ["session_id", "other_id"]).select("session_id", "id", "rank", "distance", (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy")))
    bins = near.where("rank <= 5").withColumn("bin", (F.floor(F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(180.0)) / 2) % 90).cast("int"))
    bins = bins.groupBy("session_id", "bin").agg(F.round(F.sum(1 / F.greatest("distance", F.lit(0.1))), 9).alias("w"))
    turn = bins.groupBy("session_id").agg(F.max_by("bin", F.struct("w", -F.col("bin"))).alias("bin"), F.max("w").alias("peak"), F.sum("w").alias("all"))
    turn = turn.select("session_id", F.radians(2.0 * F.col("bin") + 1).alias("angle"), F.least(6 * F.col("peak") / F.col("all"), F.lit(1.0)).alias("sureness"))
    sessions = middle.join(turn, "session_id", "left")
    reason = F.when(F.col("n") < 2 * least, "insufficient_plants").when(F.coalesce("sureness", F.lit(0.0)) < 0.1, "orientation_low_confidence")
    sessions = checkpointed(sessions.withColumn("reason", reason))
    good = sessions.where("reason is null").select("session_id", "cx", "cy", "angle")
    along, across = geometry.along_across(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("angle"))
    points = p.join(good, "session_id").withColumn("along", along).withColumn("across", across)
    da, dc = geometry.along_across(F.col("dx"), F.col("dy"), F.col("angle"))
    steps = near.join(good, "session_id").withColumn("da", F.abs(da)).withColumn("dc", F.abs(dc))
    beside = F.col("dc") < F.greatest(F.lit(5.0), 0.3 * F.col("da"))
    best = steps.groupBy("session_id", "id").agg(F.min(F.when(beside, F.col("da"))).alias("a"), F.min(F.when(~beside & (F.col("da") < F.greatest(F.lit(5.0), 0.3 * F.col("dc"))), F.col("dc"))).alias("c"))
    best = checkpointed(best)
    scale = good.join(rows.live_spacing(best, ["session_id"], "a"), "session_id", "left").withColumnRenamed("spacing", "a").join(rows.live_spacing(best, ["session_id"], "c"), "session_id", "left")
    scale = checkpointed(scale.select("session_id", F.coalesce("a", F.lit(usual)).alias("spacing"), F.coalesce("spacing", 2 * F.coalesce("a", F.lit(usual))).alias("cross")))
    points = points.join(scale, "session_id").withColumn("_half", F.col("cross") * 0.5)
    chains = sync.chain_clusters(points, ["session_id"], "across", [F.col("across"), F.col("id")], F.col("_half"))
    centers = chains.groupBy("session_id", "cluster").agg(F.avg("across").alias("center")).groupBy("session_id").agg(F.sort_array(F.collect_list("center")).alias("centers"))
    nearest = F.array_min(F.transform("centers", lambda c, i: F.struct(F.abs(F.col("across") - c).alias("off"), i.alias("row"), c.alias("center"))))
    lanes = points.join(centers, "session_id").withColumn("_row", nearest).where(F.col("_row.off") <= band * F.col("cross"))
    lanes = lanes.select("session_id", F.col("_row.row").alias("row"), F.col("_row.center").alias("center"), F.concat_ws("_", F.col("session_id").cast("string"), F.col("_row.row").cast("string")).alias("plot_id"), F.lit(0).alias("row_id"), F.col("id").alias("plant_id"), "along", F.lit(0.0).alias("across"), "spacing")
    full = lanes.groupBy("plot_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("plot_id")
    lanes = checkpointed(lanes.join(full, "plot_id", "left_semi"))
    spacing = lanes.select("plot_id", "spacing").distinct()
    missing = rows.missing_slots(rows.live_slots(lanes, spacing), lanes, spacing, tolerance)
    whose = lanes.select("plot_id", "session_id", "row", "center").distinct()
    x, y = geometry.from_along_across(F.col("along"), F.col("center"), F.col("angle"))
    gaps = missing.select("plot_id", "slot_index", "along").join(whose, "plot_id").join(good, "session_id")
    gaps = checkpointed(gaps.select("session_id", F.col("row").alias("row_id"), "slot_index", (F.col("cx") + x).alias("local_x"), (F.col("cy") + y).alias("local_y")))
    count = gaps.groupBy("session_id").agg(F.count(F.lit(1)).alias("gap_count"))
    status = F.when(F.col("reason").isNotNull(), "NOT_EVALUATED").when(F.coalesce("gap_count", F.lit(0)) == 0, "zero_gaps_confirmed").otherwise("gaps_found")
    sessions = sessions.join(count, "session_id", "left").select("session_id", F.col("n").alias("plants"), F.when(F.col("reason").isNull(), F.coalesce("gap_count", F.lit(0))).alias("gap_count"), status.alias("status"), "reason")
    return {"gaps": gaps, "sessions": sessions}


def finalizer(plants: Callable[[DataFrame], DataFrame], folder: str, **settings: float) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that judges the sessions that a batch of ``closed_sessions`` names, each once.

    ``plants`` takes the batch (session_id, started, ended, records) and gives the plants (session_id, plant_id, x, y) of its sessions. ``folder`` gets two Parquet tables, ``gaps`` and
    ``sessions``, in a partition for each batch. A batch that is run again replaces its own partitions, the status last; a session that another batch has judged is left out. A
    session without plants is not evaluated.
    """

    def finalize(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        closed = batch.groupBy("session_id").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("records").alias("records"))
        if storage.exists(spark, f"{folder}/sessions"):
            judged = spark.read.parquet(f"{folder}/sessions").where(F.col("batch_id") != batch_id).select("session_id")
            closed = closed.join(judged, "session_id", "left_anti")
        closed = checkpointed(closed)
        if closed.isEmpty():
            return
        found = live_gaps(plants(closed).join(closed.select("session_id"), "session_id", "left_semi"), **settings)
        status = closed.join(found["sessions"], "session_id", "left")
        status = status.withColumns({"plants": F.coalesce("plants", F.lit(0)), "reason": F.when(F.col("status").isNull(), "insufficient_plants").otherwise(F.col("reason")), "status": F.coalesce("status", F.lit("NOT_EVALUATED"))})
        for name, df in (("gaps", found["gaps"]), ("sessions", status)):
            df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{folder}/{name}")

    return finalize


def live_session(frames: DataFrame, least_seconds: float = 0.5, top: int = 255) -> DataFrame:
    """Streamed frames (session_id, sequence, started, captured, seconds, detections) to the boxes that the overlay shows.

    Frames from before the session's start and repeated ones are dropped, the rest admitted at most every ``least_seconds``; the boxes of a
    frame come with it as an array, so selection stays inside the row.
    """
    admitted = stateful.admitted(frames, "started", "captured", "session_id", "sequence")
    limited = stateful.rate_limited(admitted, "session_id", "seconds", least_seconds)
    good = F.filter("detections", lambda b: gates.confident(b["confidence"], 0.25))
    ranked = F.array_sort(F.transform(good, lambda b: F.struct((-b["confidence"]).alias("order"), b.alias("box"))))
    shown = F.slice(F.transform(ranked, lambda r: r["box"]), 1, top)
    return limited.select("session_id", "sequence", "captured", F.size("detections").alias("detections"), F.greatest(F.size(good) - top, F.lit(0)).alias("truncated"), shown.alias("shown"))


__all__ = ["GapSettings", "finalizer", "gap_report", "gap_totals", "live_gaps", "live_session"]
