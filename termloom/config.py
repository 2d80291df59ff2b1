"""Engine options. Every field is read somewhere; defaults are those in force when no file is given."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any

NOTE_POLICIES = ("annotate", "replace", "structured_only")
LANGUAGES = ("it", "en")


@dataclass(frozen=True)
class NormalizerConfig:
    lowercase: bool = True
    strip_accents: bool = True
    normalize_e_numbers: bool = True
    keep_ampersand: bool = False
    keep_hash: bool = False


@dataclass(frozen=True)
class PolicyConfig:
    min_safe_alias_length: int = 5
    include_technical_aliases: bool = False


@dataclass(frozen=True)
class ResolutionConfig:
    prefer_longest_match: bool = True
    target_type_priority: tuple[str, ...] = ("drug_product", "drug_brand", "ingredient")

    def priority(self, target_type: str) -> int:
        """Higher wins; 0 for types not listed."""
        order = self.target_type_priority
        return len(order) - order.index(target_type) if target_type in order else 0


@dataclass(frozen=True)
class AcceptanceConfig:
    """Thresholds for compact lengths up to `short`, up to `medium`, and beyond."""

    thresholds: tuple[float, float, float]
    short: int = 8
    medium: int = 14
    margin: float = 0.05
    keep: int = 5


@dataclass(frozen=True)
class FuzzyConfig:
    enabled: bool = False
    strategies: tuple[str, ...] = ("symspell", "ngram_rapidfuzz")
    target_types: tuple[str, ...] = ("ingredient",)
    max_tokens: int = 4
    min_token_chars: int = 3
    min_candidate_chars: int = 6
    max_edit_distance: int = 2
    prefix_length: int = 7
    gram_size: int = 3
    min_shared_grams: int = 2
    min_gram_overlap: float = 0.35
    max_blocked: int = 100
    min_token_dice: float = 0.75
    edit_acceptance: AcceptanceConfig = AcceptanceConfig((0.95, 0.90, 0.86))
    ratio_acceptance: AcceptanceConfig = AcceptanceConfig((0.96, 0.91, 0.88))


@dataclass(frozen=True)
class SemanticConfig:
    enabled: bool = False
    neighbours: int = 10
    threshold: float = 0.88
    margin: float = 0.04
    labels: tuple[str, ...] = ("DRUG",)
    min_candidate_chars: int = 3
    priority: int = 55
    #: "module:function" of the plug-ins that engine.build() loads: an encoder of texts and a recogniser of entities.
    encoder: str = ""
    recogniser: str = ""


@dataclass(frozen=True)
class PathsConfig:
    """Folders that tables.write_kb() and tables.write_vectors() wrote."""

    knowledge_base: str = ""
    index: str = ""


@dataclass(frozen=True)
class EngineConfig:
    output_language: str = "en"
    note_output_policy: str = "annotate"
    ambiguous_brand_policy: str = "do_not_expand"
    include_excipients: bool = False
    include_unsafe_aliases: bool = False
    normalizer: NormalizerConfig = field(default_factory=NormalizerConfig)
    policy: PolicyConfig = field(default_factory=PolicyConfig)
    resolution: ResolutionConfig = field(default_factory=ResolutionConfig)
    fuzzy: FuzzyConfig = field(default_factory=FuzzyConfig)
    semantic: SemanticConfig = field(default_factory=SemanticConfig)
    paths: PathsConfig = field(default_factory=PathsConfig)

    def __post_init__(self) -> None:
        if self.note_output_policy not in NOTE_POLICIES:
            raise ValueError(f"note_output_policy must be one of {NOTE_POLICIES}")
        if self.output_language not in LANGUAGES:
            raise ValueError(f"output_language must be one of {LANGUAGES}")
        if unknown := set(self.fuzzy.strategies) - {"symspell", "ngram_rapidfuzz"}:
            raise ValueError(f"unknown fuzzy strategies: {sorted(unknown)}")


def from_mapping(values: dict[str, Any], kind: type = EngineConfig):
    """A config from nested mappings; keys that the config doesn't have are passed over."""
    out = {}
    for f in dataclasses.fields(kind):
        if f.name in values:
            v = values[f.name]
            default = f.default_factory() if f.default is dataclasses.MISSING else f.default
            out[f.name] = from_mapping(v, type(default)) if dataclasses.is_dataclass(default) else tuple(v) if isinstance(v, list) else v
    return dataclasses.replace(kind() if kind is not AcceptanceConfig else AcceptanceConfig((1.0, 1.0, 1.0)), **out)


def load_config(path: str) -> EngineConfig:
    """Read a YAML file; an empty one gives the defaults."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f) or {})
