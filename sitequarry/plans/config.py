"""Thresholds and rule switches."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class Thresholds:
    """Fixed defaults."""

    title_min_chars: int = 30
    title_max_chars: int = 60
    title_min_px: int = 200
    title_max_px: int = 561
    desc_min_chars: int = 70
    desc_max_chars: int = 155
    desc_min_px: int = 400
    desc_max_px: int = 985
    thin_content_words: int = 80
    low_text_ratio: float = 0.1
    slow_page_ms: float = 2000
    redirect_chain_max: int = 1
    near_dup_similarity: float = 0.75
    weak_inlink_count: int = 1
    url_max_chars: int = 115
    sitemap_max_urls: int = 50_000
    sitemap_max_bytes: int = 52_428_800
    js_only_content_ratio: float = 0.5
    excessive_links_count: int = 300
    deep_page_depth: int = 4
    soft_404_max_words: int = 120
    long_content_words: int = 300
    empty_anchor_ratio_max: float = 0.3
    no_compression_min_bytes: int = 2000
    flesch_min: float = 30
    oversized_html_bytes: int = 512_000


@dataclass(frozen=True)
class Config:
    thresholds: Thresholds = Thresholds()
    disabled: frozenset[str] = frozenset()
    severities: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def load(overrides: dict | None = None) -> Config:
        """Defaults with overrides ({"thresholds": {...}, "rules": {id: {"enabled": bool, "severity": str}}}), checked."""
        overrides = overrides or {}
        known = {f.name for f in fields(Thresholds)}
        own = overrides.get("thresholds", {})
        if unknown := set(own) - known:
            raise ValueError(f"unknown thresholds: {sorted(unknown)}")
        if bad := [k for k, v in own.items() if isinstance(v, bool) or not isinstance(v, int | float) or v < 0]:
            raise ValueError(f"thresholds must be numbers of at least 0: {sorted(bad)}")
        t = replace(Thresholds(), **own)
        for low, high in (("title_min_chars", "title_max_chars"), ("title_min_px", "title_max_px"), ("desc_min_chars", "desc_max_chars"), ("desc_min_px", "desc_max_px")):
            if asdict(t)[low] > asdict(t)[high]:
                raise ValueError(f"{low} is above {high}")
        rules = overrides.get("rules", {})
        if bad := [k for k, v in rules.items() if v.get("severity") not in (None, "error", "warning", "notice")]:
            raise ValueError(f"unknown severities: {sorted(bad)}")
        return Config(t, frozenset(k for k, v in rules.items() if v.get("enabled") is False), {k: v["severity"] for k, v in rules.items() if v.get("severity")})
