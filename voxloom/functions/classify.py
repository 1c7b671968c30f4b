"""Classes of throats, bonds, damage and edges as conditional expressions with a stated rule for NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds and class names: fixed values.
COVER_HIGH, COVER_LOW = 0.50, 0.20
MODE_HIGH = 0.80
SWEEP = (0.5, 0.7, 0.8, 0.9)
Q_ADHESIVE, Q_COHESIVE = 0.15, 0.30
FACE_CLASSES = ("cohesive", "adhesive", "stripped", "mixed", "unmeasured")
Q_CLASSES = ("intact", "adhesive", "cohesive", "mixed")
GAP_MAX = 12.0
MIN_DSUM, MIN_CRACK = 7.0, 200.0
MIN_DAMAGE, PLANAR, THIN_CRACK, GLASS_SHARE, ICE_SHARE, FULL_LENGTH = 50, 0.6, 2.0, 0.55, 0.55, 0.5
CRUSH, DELAMINATED, COHESIVE, MIN_ZONE = 0.80, 0.70, 0.30, 20
THIN_RATIO = 0.50


def face_class(cover_a: Column, cover_b: Column) -> Column:
    """Both faces covered: cohesive; one covered and the other bare: adhesive; both bare: stripped; else mixed. A missing cover: unmeasured."""
    low, high = F.least(cover_a, cover_b), F.greatest(cover_a, cover_b)
    missing = cover_a.isNull() | cover_b.isNull()
    return F.when(missing, "unmeasured").when(low >= COVER_HIGH, "cohesive").when((high >= COVER_HIGH) & (low < COVER_LOW), "adhesive").when(high < COVER_LOW, "stripped").otherwise("mixed")


def bare_bead(cover_a: Column, cover_b: Column, bead_a: Column, bead_b: Column) -> Column:
    """The bead whose face is bare where the class is adhesive, else 0."""
    return F.when(face_class(cover_a, cover_b) == "adhesive", F.when(cover_a <= cover_b, bead_a).otherwise(bead_b)).otherwise(F.lit(0))


def asymmetry(cover_a: Column, cover_b: Column) -> Column:
    return F.abs(cover_a - cover_b) / F.greatest(cover_a + cover_b, F.lit(1e-9))


def q_class(crack_vox: Column, q: Column, connected: Column | None = None) -> Column:
    """By the crack's place q between the faces; a missing q: mixed. Without enough crack: intact.

    With ``connected``, the variant for single throats: detached first, and NULL instead of intact.
    """
    place = F.when(q <= Q_ADHESIVE, "adhesive").when(q >= Q_COHESIVE, "cohesive").otherwise("mixed")
    if connected is None:
        return F.when(crack_vox < MIN_CRACK, "intact").otherwise(place)
    return F.when(~connected, "detached").when(crack_vox < MIN_CRACK, F.lit(None).cast("string")).otherwise(place)


def mode_at(cover_a: Column, cover_b: Column, threshold: Column | float) -> Column:
    """The published rule of two classes: cohesive if both faces are covered to the threshold, else adhesive."""
    return F.when(F.least(cover_a, cover_b) >= threshold, "cohesive").otherwise("adhesive")


def answerable(dsum_min: Column, crack_vox: Column, inclusive: bool = True) -> Column:
    return (dsum_min >= MIN_DSUM) & (crack_vox >= MIN_CRACK if inclusive else crack_vox > MIN_CRACK)


def dip_class(dip: Column, low: float = 20.0, high: float = 70.0) -> Column:
    """Variants: (20, 70) and (30, 60) degrees."""
    return F.when(dip >= high, "vertical").when(dip >= low, "diagonal").otherwise("horizontal")


def damage_class(n_vox: Column, planarity: Column, thickness: Column, glass_share: Column, ice_share: Column) -> Column:
    """In order of priority; missing shares count as 0."""
    g, i = F.coalesce(glass_share, F.lit(0.0)), F.coalesce(ice_share, F.lit(0.0))
    return F.when(n_vox < MIN_DAMAGE, "NOISE").when((planarity >= PLANAR) & (thickness <= THIN_CRACK), "CRACK").when(g >= GLASS_SHARE, "DELAMINATION").when(i >= ICE_SHARE, "ICE-FRACTURE").otherwise("CAVITY")


def fully_developed(damage: Column, percolates: Column, length: Column, extent: Column) -> Column:
    """A crack that reaches the boundary and is at least half as long as the specimen is high."""
    return (damage == "CRACK") & percolates & (length / extent >= FULL_LENGTH)


def bond_state(ice_before: Column, ice_after: Column) -> Column:
    """BROKEN without ice after, WEAKENED below half of before, else SURVIVING; NULL after counts as none."""
    after = F.coalesce(ice_after, F.lit(0))
    return F.when(after == 0, "BROKEN").when(after < 0.50 * ice_before, "WEAKENED").otherwise("SURVIVING")


def volume_mode(air: Column, ice: Column, contact: Column) -> Column:
    """Failure mode from the volumes between two beads; too little of everything: UNCLEAR."""
    total, gap = air + ice + contact, air + ice
    delaminated = F.coalesce(F.try_divide(air, gap), F.lit(0.0))
    crushed = ((contact > 0) & (gap < MIN_ZONE)) | (contact / total >= CRUSH)
    return F.when(total < MIN_ZONE, "UNCLEAR").when(crushed, "CRUSHED").when(delaminated >= DELAMINATED, "DELAMINATION").when(delaminated <= COHESIVE, "COHESIVE").otherwise("MIXED")


def dryness_band(change: Column) -> Column:
    return F.when(change.isNull(), "unmeasured").when(change > 0.30, "strong").when(change > 0.10, "mild").when(change >= -0.10, "stable").otherwise("wetter")


def edge_status(node_a: Column, node_b: Column, thick_before: Column, thick_after: Column) -> Column:
    """broken: an end has no image, both have the same, or the pair is absent after; weakened: less than half as thick."""
    gone = node_a.isNull() | node_b.isNull() | (node_a == node_b) | thick_after.isNull()
    return F.when(gone, "broken").when(thick_after / thick_before < THIN_RATIO, "weakened").otherwise("kept")


def survival_outcome(gap_after: Column, connected_after: Column) -> Column:
    """lost: not found again; separated: further apart than the largest gap; detached: no longer connected."""
    return F.when(gap_after.isNull(), "lost").when(gap_after > GAP_MAX, "separated").when(connected_after, "survived").otherwise("detached")


def phase_of(grey: Column, air_ice: Column | float, ice_grain: Column | float, inside: Column | None = None, top: Column | float | None = None) -> Column:
    """Half-open bands: below the first threshold air, below the second ice, below ``top`` (if there is one) grain; all else 0."""
    code = F.when(grey < air_ice, 1).when(grey < ice_grain, 2)
    code = code.otherwise(3) if top is None else code.when(grey < top, 3).otherwise(0)
    return code if inside is None else F.when(inside, code).otherwise(0)
