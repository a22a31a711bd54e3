"""Fixed values of the drawing data model, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Canvas:
    # fixed values
    width: int = 568
    height: int = 274
    crop_padding: int = 5
    white_threshold: int = 250
    binarise: int = 127
    binarise_augmented: int = 175
    line_thickness: float = 2.0


@dataclass(frozen=True)
class MatchTolerance:
    # fixed values
    position: float = 120.0
    angle: float = 50.0
    length: float = 0.8
    threshold: float = 0.5
    min_extra_length: float = 30.0
    w_position: float = 0.5
    w_angle: float = 0.3
    w_length: float = 0.2


@dataclass(frozen=True)
class Detector:
    # fixed values
    strict_votes: int = 15
    strict_length: int = 35
    relaxed_votes: int = 10
    relaxed_length: int = 25
    max_gap: int = 35
    rounds: int = 20
    strict_rounds: int = 10
    max_lines: int = 12
    final_length: float = 30.0
    erase_radius: float = 6.0
    overlap_angle: float = 8.0
    overlap_distance: float = 25.0
    crossing_low: float = 80.0
    crossing_high: float = 100.0


@dataclass(frozen=True)
class Augmentation:
    # fixed values
    rotation: tuple[float, float] = (-3.0, 3.0)
    shift: tuple[int, int] = (-10, 10)
    scale: tuple[float, float] = (0.95, 1.05)
    variants: int = 5
    global_share: float = 0.6
    safety_margin: int = 15
    warp_displacement: int = 15
    warp_edge: int = 10


@dataclass(frozen=True)
class Alignment:
    # fixed values
    min_ink: int = 100
    accept_iou: float = 0.15
    max_rotation: float = 30.0
    scale: tuple[float, float] = (0.85, 1.25)
    max_shift: int = 15
    similar: tuple[float, float] = (0.85, 1.15)
    prescale: tuple[float, float] = (0.5, 2.5)


CANVAS = Canvas()
TOLERANCE = MatchTolerance()
DETECTOR = Detector()
AUGMENTATION = Augmentation()
ALIGNMENT = Alignment()

# fixed values: score ranges of the known tests
SCORE_RANGES = {
    "MMSE": (0.0, 30.0),
    "ACE": (0.0, 100.0),
    "Total_Score": (0.0, 60.0),
    "Park_Total": (0.0, 60.0),
    "MoCA": (0.0, 30.0),
    "CDR": (0.0, 3.0),
}

# fixed values: preset class names by number of classes
PRESET_CLASS_NAMES = {
    2: ["Poor", "Good"],
    3: ["Poor", "Fair", "Good"],
    4: ["Poor", "Fair", "Good", "Excellent"],
    5: ["Poor", "Fair", "Moderate", "Good", "Excellent"],
}

# fixed values: corner points of the default template, in drawing order
TEMPLATE_POINTS = [
    (234, 187), (334, 187), (334, 87), (234, 87), (284, 37),
    (334, 87), (234, 187), (234, 87), (284, 37), (334, 187),
]
