"""Configuration: defaults, presets, YAML and validation."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

SECTIONS = ("detection", "reid", "gallery", "queues")


@dataclass
class Detection:
    confidence: float = 0.3
    iou: float = 0.55


@dataclass
class Embedding:
    batch_size: int = 16
    precision: str = "fp16"
    compiled: bool = False
    dimension: int = 2048


@dataclass
class Gallery:
    max_size: int = 500
    buffer: int = 10
    match: float = 0.70
    new: float = 0.50
    ttl_crowded: int = 30
    ttl_sparse: int = 150


@dataclass
class Queues:
    input: int = 10
    processing: int = 50
    output: int = 20


@dataclass
class Config:
    detection: Detection = field(default_factory=Detection)
    reid: Embedding = field(default_factory=Embedding)
    gallery: Gallery = field(default_factory=Gallery)
    queues: Queues = field(default_factory=Queues)
    device: str = "cuda"

    @classmethod
    def from_dict(cls, tree: dict) -> Config:
        """Missing sections take defaults; an unknown key of a section raises TypeError, an unknown section is ignored."""
        kinds = {f.name: f.default_factory for f in fields(cls) if f.name in SECTIONS}
        parts = {name: kind(**tree.get(name, {})) for name, kind in kinds.items()}
        return cls(**parts, **({"device": tree["device"]} if "device" in tree else {}))

    @classmethod
    def load(cls, source: str) -> Config:
        """A preset by name, else a YAML file."""
        if source in PRESETS:
            return cls.from_dict(PRESETS[source])
        import yaml

        with open(source) as f:
            return cls.from_dict(yaml.safe_load(f) or {})

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(asdict(self), sort_keys=False)

    def summary(self) -> str:
        """Short text of the settings that matter most, a section a line."""
        return "\n".join(f"{name}: " + ", ".join(f"{k}={v}" for k, v in values.items()) if isinstance(values, dict) else f"{name}: {values}" for name, values in asdict(self).items())

    def problems(self) -> list[str]:
        """What is out of range; nothing is raised."""
        found = []
        for name, value in (("detection.confidence", self.detection.confidence), ("detection.iou", self.detection.iou), ("gallery.match", self.gallery.match), ("gallery.new", self.gallery.new)):
            if not 0 <= value <= 1:
                found.append(f"{name} must be from 0 to 1")
        if self.gallery.max_size < 1:
            found.append("gallery.max_size must be positive")
        if self.reid.dimension not in (512, 1024, 2048):
            found.append("reid.dimension must be 512, 1024 or 2048")
        return found


#: What each preset changes.
PRESETS = {
    "xavier_nx": {"reid": {"batch_size": 8, "precision": "fp16", "compiled": True}, "gallery": {"max_size": 300, "buffer": 5, "ttl_crowded": 30, "ttl_sparse": 100}, "queues": {"input": 5, "processing": 30, "output": 15}},
    "orin_nx": {"reid": {"batch_size": 16, "precision": "int8", "compiled": True}},
    "agx_orin": {"detection": {"confidence": 0.25}, "reid": {"batch_size": 32, "precision": "int8", "compiled": True}, "gallery": {"max_size": 1000, "ttl_crowded": 50, "ttl_sparse": 200}, "queues": {"input": 20, "processing": 100, "output": 30}},
    "development": {},
}
