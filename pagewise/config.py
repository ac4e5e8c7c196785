"""Settings of a run, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    ocr_threshold: float = 0.60
    vision_threshold: float = 0.35
    vision_max_pages: int = 5
    vision_probe: bool = True
    vision_disagreement: float = 0.05
    ocr_shards: int = 1
    upload_bytes: int = 256 << 20
    #: Seconds after which stored documents go; None keeps them.
    ttl_seconds: int | None = None

    def __post_init__(self):
        if not 0 <= self.ocr_threshold <= 1 or not 0 <= self.vision_threshold <= 1:
            raise ValueError("thresholds lie between 0 and 1")
        if self.vision_threshold > 0 and self.vision_threshold >= self.ocr_threshold:
            raise ValueError("vision_threshold must be below ocr_threshold: it is the second step of escalation")
        if not 0 < self.vision_disagreement <= 1:
            raise ValueError("vision_disagreement lies above 0 and up to 1")
        if self.vision_max_pages < 1 or self.ocr_shards < 1 or self.upload_bytes < 1:
            raise ValueError("vision_max_pages, ocr_shards and upload_bytes are positive")
        if self.ttl_seconds is not None and self.ttl_seconds <= 0:
            raise ValueError("ttl_seconds is positive, or None for no sweep")

    @classmethod
    def from_env(cls, env: dict[str, str], prefix: str = "PAGEWISE_") -> Config:
        """Settings from variables such as PAGEWISE_OCR_THRESHOLD; what is not set keeps its default."""
        kinds = {"ocr_threshold": float, "vision_threshold": float, "vision_disagreement": float, "vision_max_pages": int, "ocr_shards": int, "upload_bytes": int, "ttl_seconds": int, "vision_probe": lambda v: {"true": True, "1": True, "false": False, "0": False}[v.lower()]}
        found = {}
        for name, kind in kinds.items():
            if (raw := env.get(prefix + name.upper(), "").strip()) != "":
                try:
                    found[name] = kind(raw)
                except (ValueError, KeyError) as e:
                    raise ValueError(f"{prefix}{name.upper()}={raw!r} is no valid setting") from e
        return cls(**found)
