"""What a run can be told."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators import merge, tables

# What Markdown modes are called on the command line, and models that a provider has by default.
MODES = {"translated_only": "translated", "original_only": "original", "parallel": "parallel"}
MODELS = {"gemini": "gemini-3-flash-preview", "openai": "gpt-4o-mini", "anthropic": "claude-sonnet-4-5-20250514"}
ORDERS = ("translated_original", "original_translated")


@dataclass(frozen=True)
class ImageConfig:
    enabled: bool = True
    folder: str = "images"
    format: str = "png"
    quality: int = 95
    min_size: tuple[int, int] = (50, 50)
    dpi: int = 150
    naming: str = "sequential"  # or page_index: numbered by page


@dataclass(frozen=True)
class ThumbnailConfig:
    width: int = 400
    page_number: int = 0


@dataclass(frozen=True)
class SideBySideConfig:
    order: str = "translated_original"
    gap: float = 0.0

    def __post_init__(self) -> None:
        if self.order not in ORDERS:
            raise ValueError(f"order is one of {ORDERS}")


@dataclass(frozen=True)
class SubsetConfig:
    font: str = "font"
    number: int = 0
    margin: bool = True  # common punctuation and digits in each set


@dataclass(frozen=True)
class ModelConfig:
    provider: str = "gemini"
    model: str | None = None
    use_summary: bool = False
    use_fallback: bool = False

    @property
    def effective_model(self) -> str | None:
        return self.model or MODELS.get(self.provider)


@dataclass(frozen=True)
class PipelineConfig:
    source_lang: str = "en"
    target_lang: str = "ja"
    merge: merge.MergeConfig = field(default_factory=merge.MergeConfig)
    translated_at: str | None = None
    batch_size: int = 20
    strict: bool = False
    page_breaks: bool = True
    merge_adjacent: bool = True
    threshold: float = 0.5
    translatable: tuple[str, ...] | None = None
    max_retries: int = 3
    retry_delay: float = 1.0
    max_concurrent: int | None = None  # the backend's own limit, else ten
    min_font_size: float = 6.0
    page_range: tuple[int, ...] | None = None
    mode: str = "translated"
    metadata: bool = True
    heading_offset: int = 0
    skip: tuple[str, ...] | None = None
    tables: tables.TableConfig = field(default_factory=tables.TableConfig)
    table_mode: str = "heuristic"
    extract_tables: bool = True
    images: ImageConfig = field(default_factory=ImageConfig)
    thumbnail: ThumbnailConfig | None = None
    side_by_side: SideBySideConfig | None = None
    subset: SubsetConfig | None = None
    model: ModelConfig = field(default_factory=ModelConfig)
    summary: bool = True

    def __post_init__(self) -> None:
        if self.mode not in MODES.values():
            raise ValueError(f"mode is one of {tuple(MODES.values())}")
