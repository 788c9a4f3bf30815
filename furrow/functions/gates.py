"""Predicates that classify: quality gates, statuses, levels and reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions.boxes import finite

# The receiver's name for each known positioning code.
RTK = {
    0: "NOT_AVAILABLE",
    1: "FIX_POSITION",
    2: "FIX_HEIGHT_AUTO",
    8: "INSTANTANEOUS_DOPPLER_VELOCITY",
    16: "SINGLE_PNT_SOLUTION",
    17: "PSEUDORANGE_DIFFERENTIAL",
    18: "SBAS_CORRECTION",
    19: "KALMAN_FILTER_PROPAGATED",
    20: "OMNISTAR_VBS",
    32: "FLOAT_L1_AMBIGUITY",
    33: "FLOAT_IONOSPHERIC_FREE_AMBIGUITY",
    34: "FLOAT_SOLUTION",
    48: "L1_AMBIGUITY_INT",
    49: "WIDE_LANE_AMBIGUITY_INT",
    50: "NARROW_INT",
}


def confident(confidence: Column, least: float) -> Column:
    return finite(confidence) & (confidence >= least)


def reasons(*tests: tuple[str, Column], none: str = "accepted") -> Column:
    """Names of the tests that hold, joined by ``|``; ``none`` if no test holds. A null test doesn't hold."""
    joined = F.concat_ws("|", *[F.when(test, F.lit(name)) for name, test in tests])
    return F.when(joined == "", F.lit(none)).otherwise(joined)


def mask_gate(inside: Column, distance: Column, buffer: float) -> Column:
    return F.when(~inside, "outside_rejected").when(distance < buffer, "boundary_review").otherwise("accepted")


def in_roi(x: Column, y: Column, width: Column | float, height: Column | float) -> Column:
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def support_status(observations: Column, opportunity: Column, confirmed_at: int = 2, suspicious_at: int = 3) -> Column:
    """Order matters: enough observations, then a single one that one frame at most could see, then a single one that many could."""
    once = observations == 1
    return (
        F.when(observations >= confirmed_at, "confirmed")
        .when(once & (opportunity <= 1), "boundary_singleton")
        .when(once & (opportunity >= suspicious_at), "suspicious_singleton")
        .otherwise("low_support")
    )


def confidence_level(c: Column, strict: bool = False) -> Column:
    level = F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")
    return F.when((c < 0) | (c > 1), F.raise_error(F.lit("confidence outside 0..1"))).otherwise(level) if strict else level


def gap_evidence(suspicious: Column, confidence: Column) -> Column:
    return F.when(suspicious > 0, "review_near_suspicious_support").when(confidence >= 0.8, "high_candidate").when(confidence >= 0.5, "medium_candidate").otherwise("low_candidate_review")


def candidate_rejection(boundary: Column, buffer: Column, coverage: Column, least: Column) -> Column:
    """The first gate that a candidate fails, null if it passes."""
    return F.when(boundary < buffer, "polygon_boundary_exclusion_buffer").when(coverage < least, "insufficient_visibility_opportunity")


def slot_reasons(coverage: Column, suspicious: Column) -> Column:
    """Why a slot counts as missing, joined by ``|`` (fixed names)."""
    found = [F.lit("no_unique_plant_within_robust_spacing_tolerance"), F.concat(F.lit("coverage_opportunity="), coverage.cast("string")), F.lit("internal_slot_boundary_gate_passed")]
    doubt = F.concat(F.lit("nearby_suspicious_singletons="), suspicious.cast("string"), F.lit("|confidence_downgraded_for_low_support_evidence"))
    return F.concat_ws("|", *found, F.when(suspicious > 0, doubt))


def located(level: Column, value: Column) -> Column:
    """A coordinate if the receiver's level says that there is a position, else null."""
    return F.when(F.coalesce(level, F.lit(0)) > 0, value)


def at_cadence(frame: Column, interval: int) -> Column:
    return frame % interval == 0


def component_confidence(coverage: Column, plants: Column) -> Column:
    return F.when((coverage >= 0.995) & (plants >= 1000), "high").otherwise("review")


def downgraded(confidence: Column, suspicious: Column) -> Column:
    return F.when(suspicious > 0, confidence * 0.5).otherwise(confidence)


def rtk_meaning(code: Column) -> Column:
    known = F.create_map(*[F.lit(v) for pair in RTK.items() for v in pair])
    return F.when(code.isNull() | (code < 0), "UNKNOWN").otherwise(F.coalesce(known[code], F.concat(F.lit("UNKNOWN_"), code.cast("string"))))


def rtk_quality(code: Column) -> Column:
    """Bands of the known codes; other codes aren't guessed at."""
    band = F.when(code >= 48, "FIXED").when(code >= 32, "FLOAT").when(code >= 16, "APPROXIMATE").when(code >= 1, "LOW_QUALITY").otherwise("UNAVAILABLE")
    return F.when(code.isNull() | (code < 0), "UNAVAILABLE").when(code.isin([*RTK]), band).otherwise("UNKNOWN")


def valid_if(mask: Column, bit: int, value: Column) -> Column:
    """The value if its bit in the validity mask is set, else null."""
    return F.when(mask.bitwiseAND(F.lit(1 << bit)) != 0, value)


def fatal_warning(text: Column) -> Column:
    return F.lower(text).rlike("cuda|tensorrt|out of memory|engine deserial")


def component_category(width: Column, center_x: Column, mosaic_width: Column) -> Column:
    wide = width >= 0.38 * mosaic_width
    return F.when(wide, "main_planted_block").when(center_x < 0.5 * mosaic_width, "left_side_planted_strip").otherwise("right_side_planted_strip")
