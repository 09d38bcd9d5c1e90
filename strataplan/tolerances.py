"""Tolerances of the detection, in metres unless said otherwise."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Tolerances:
    # Fixed values.
    touch: float = 0.02
    paint_gap: int = 3
    min_side: float = 0.15
    rectness: float = 0.95
    dup_iou: float = 0.9
    dash_max: float = 2.0
    dash_degrees: float = 0.2
    collinear: float = 0.03
    dash_min_pieces: int = 8
    dash_cover: float = 0.97
    hatch_len: tuple[float, float] = (0.05, 1.0)
    hatch_search: float = 0.5
    hatch_neighbours: int = 3
    hatch_gap: float = 0.06
    hatch_min_strokes: int = 20
    outline_min_area: float = 0.1
    outline_max_area: float = 60.0
    outline_rectness: float = 0.97
    band_offset: float = 0.05
    band_run_gap: float = 0.6
    building_k: int = 5
    building_radius: float = 25.0
    area_buffer: float = 15.0
    band_min: float = 0.1
    band_max: float = 1.5
    band_bin: float = 0.01
    band_peak_min: float = 15.0
    band_peak_share: float = 0.01
    band_tol: float = 0.015
    band_holds: tuple[float, float] = (0.1, 0.9)
    band_holding: float = 0.15
    line_min: float = 0.5
    overlap_min: float = 0.5
    inside_margin: float = 0.005
    label_radius: float = 1.5
    unmatched_cost: float = 3.5
    align_weight: float = 1.0
    long_object: float = 6.0
    distance_unit: float = 0.5
    name_min_votes: int = 5
    name_margin: float = 1.5
    name_small: tuple[int, float] = (2, 0.3)
    name_min_labelled: float = 0.1
    clusters: tuple[int, int] = (6, 14)
    similar_max: float = 1.6
    unnamed_penalty: float = 1.0
    sure_distance: float = 0.3
    size_penalty: float = 1.5
    size_tol: float = 0.03
    width_tol: float = 0.02
    parallel_deg: float = 15.0
    footprint_grow: float = 1.0
    edge_margin: float = 0.6
    near: float = 0.05
    grow: float = 0.03
    dot_max: float = 0.1
    wall_default: float = 0.25
    fuse: float = 0.01
    stretch_thickness: tuple[float, float] = (0.1, 0.6)
    stretch_min_len: float = 0.3
    bent_fill_min_area: float = 0.5
    thin_default: float = 0.4
    hatch_local: float = 0.8
    hatch_min_len: float = 0.3
    run_dup: float = 0.02
    on_border: float = 0.015
    on_region: float = 0.1
    stroke_max: float = 1.0
    stroke_reach: float = 0.01
    hatch_spread: float = 0.5
    footprint_close: float = 3.0
    joint_min_len: float = 15.0
    joint_gap: tuple[float, float] = (0.03, 0.16)
    joint_cut: float = 0.1
    joint_margin: float = 1.0
    region_min_area: float = 20.0
    region_dominant: float = 0.7
    region_penalty: float = 1.5
    pen_share: float = 0.1
    trace_zone: float = 2.0
    trace_snap: float = 0.05
    trace_min_line: float = 0.1
    trace_wall_reach: float = 0.1
    ray_min: float = 1.5
    ray_start: float = 0.4
    ray_reach: float = 2.0


# Classes by label kind, their order, families, names and element types.
LABEL_CLASS = {
    "column": "column", "wall": "shear_wall", "retaining_wall": "retaining_wall", "retaining_wall+strip_footing": "strip_footing",
    "footing:S": "isolated_footing", "footing:SC": "combined_footing", "grade_beam": "grade_beam", "strip_footing": "strip_footing", "raft": "raft", "pit": "sump_pit",
}
CLASS_ORDER = ["column", "shear_wall", "core_wall", "retaining_wall", "isolated_footing", "combined_footing", "strip_footing", "grade_beam", "raft", "sump_pit"]
FAMILY = {
    "column": "column", "shear_wall": "wall", "retaining_wall": "wall", "core_wall": "wall", "isolated_footing": "footing", "combined_footing": "footing",
    "strip_footing": "strip", "grade_beam": "beam", "raft": "raft", "sump_pit": "pit",
}
ELEMENT_TYPE = {
    "column": "column", "shear_wall": "wall", "retaining_wall": "wall", "core_wall": "wall", "isolated_footing": "footing", "combined_footing": "footing",
    "strip_footing": "footing", "grade_beam": "beam", "raft": "slab_raft", "sump_pit": "other",
}
CLASS_NAME = {
    "column": "Column", "shear_wall": "Shear wall", "retaining_wall": "Retaining wall", "core_wall": "Core wall", "isolated_footing": "Isolated footing",
    "combined_footing": "Combined footing", "strip_footing": "Strip footing", "grade_beam": "Grade beam", "raft": "Raft", "sump_pit": "Sump pit",
}
CLASS_COLOURS = {
    "column": (0.0, 0.65, 0.0), "shear_wall": (0.85, 0.0, 0.0), "retaining_wall": (0.6, 0.0, 0.3), "core_wall": (0.9, 0.4, 0.6), "isolated_footing": (1.0, 0.45, 0.0),
    "combined_footing": (0.55, 0.25, 0.0), "strip_footing": (0.9, 0.7, 0.0), "grade_beam": (0.1, 0.3, 0.9), "raft": (0.5, 0.0, 0.8), "sump_pit": (0.3, 0.3, 0.3),
}
UNNAMED_COLOUR = (0.45, 0.45, 0.45)
KIND_WORDS = {
    "solid": ("filled shape", "filled shapes"), "outline": ("closed outline", "closed outlines"), "band": ("pair of parallel lines", "pairs of parallel lines"),
    "cross_hatch": ("cross-hatched area", "cross-hatched areas"), "single_hatch": ("hatched area", "hatched areas"), "stamped_region": ("stamped region", "stamped regions"),
}
GROUP_FACTS = [
    ("on_stamped_region", "on a stamped region"), ("inside_outline", "inside a closed outline"), ("touches_solid", "touching filled shapes"), ("dots_inside", "with a pattern inside"),
    ("solids_inside", "with filled shapes inside"), ("nested_boxes", "drawn as nested boxes"), ("on_perimeter", "on the building edge"),
]
