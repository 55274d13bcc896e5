"""Settings: defaults overlaid by a stored document, and a short history of descriptions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

HISTORY = 20

# Anchors that tags are measured against, and the presets of a fresh start.
CONTENT_ANCHOR = "abstract pattern, random noise, blank image, nothing recognizable"
STYLE_ANCHOR = "unknown style, unrecognizable technique, random visual"
PRESETS = {
    "Photography": {"content": "person, animal, nature, portrait, landscape, cityscape, vehicle", "style": "black and white, macro, polaroid, long exposure, cinematic lighting"},
    "Anime/Art": {"content": "1girl, 1boy, solo, multiple girls, animal ears, building, mecha", "style": "anime, sketch, watercolor, line art, 3d render, flat color, concept art"},
}


@dataclass
class Settings:
    """Parameters of a sort run."""

    source_folder: str = ""
    target_folder: str = ""
    recursive: bool = True
    fast_rating: bool = False
    ai_filter: bool = True
    dual_vote: bool = True
    content_filter: bool = False
    style_filter: bool = False
    visual_clusters: bool = False
    dedup: bool = False
    metadata: bool = False
    move_files: bool = False
    use_adapter: bool = True
    optimize_models: bool = False
    content_tags: str = "person, animal, landscape, vehicle, food, building, game character"
    style_tags: str = "anime, realistic photo, sketch, oil painting, 3d render, pixel art, watercolor"
    content_anchor: str = CONTENT_ANCHOR
    style_anchor: str = STYLE_ANCHOR
    group_descriptions: str = ""
    tag_preset: str = "None"
    content_confidence: float = 0.05
    style_confidence: float = 0.05
    #: A percentile, 0 to 100.
    sensitivity: float = 35.0
    dedup_threshold: float = 0.88
    batch_size: int = 4
    precision: str = "auto"
    metadata_per_folder: int = 0
    metadata_tokens: int = 0
    metadata_tags: int = 30
    group_desc_history: list[str] = field(default_factory=list)
    tag_presets: dict[str, dict[str, str]] = field(default_factory=lambda: {k: dict(v) for k, v in PRESETS.items()})

    def __post_init__(self):
        if not 0 <= self.sensitivity <= 100:
            raise ValueError("sensitivity is a percentile, 0 to 100")
        if not 0 < self.dedup_threshold <= 1:
            raise ValueError("dedup_threshold is a cosine, above 0 and at most 1")

    def models(self) -> set[str]:
        """The models that these criteria need; no other is loaded."""
        image = self.content_filter or self.style_filter or bool(self.group_descriptions)
        needed = {"vote": self.ai_filter, "second_vote": self.ai_filter and self.dual_vote, "text_image": image or self.visual_clusters or self.dedup, "visual": self.visual_clusters or self.dedup, "tagger": self.metadata or self.fast_rating or self.visual_clusters}
        return {name for name, wanted in needed.items() if wanted}

    def remember(self, description: str) -> None:
        """Puts a new description first; the newest HISTORY are kept."""
        if description and description not in self.group_desc_history:
            self.group_desc_history = [description, *self.group_desc_history][:HISTORY]


def load_settings(path: str) -> Settings:
    """Stored values over defaults, key by key; unknown keys and unreadable files are ignored."""
    try:
        stored = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return Settings()
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in stored.items() if k in known}) if isinstance(stored, dict) else Settings()


def save_settings(settings: Settings, path: str) -> None:
    Path(path).write_text(json.dumps(asdict(settings), ensure_ascii=False, indent=2), encoding="utf-8")
