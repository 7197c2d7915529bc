"""Domain packs, rules and metrics as data. YAML files are read on the driver; they become small literals in plans."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ColumnRule:
    match: tuple[str, ...]
    role: str
    metric_key: str | None = None
    entity_type: str | None = None
    qualifier_key: str | None = None
    expect_unit: str | None = None
    unit_from_header: bool = False
    stat_from_header: bool = False
    value_type: str = "decimal"


@dataclass(frozen=True)
class TableType:
    name: str
    captions: tuple[str, ...]
    signature: tuple[str, ...]
    min_overlap: int
    columns: tuple[ColumnRule, ...]


@dataclass(frozen=True)
class EntityPattern:
    """A regular expression, the names of its groups in order, and the id's template. `upper` names the groups to be
    upper-cased; `aliases` gives a group another text where it holds a mark."""

    regex: str
    template: str
    groups: tuple[str, ...]
    upper: tuple[str, ...] = ()
    aliases: dict[str, dict[str, str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Pack:
    name: str
    version: int
    table_types: tuple[TableType, ...]
    entity_patterns: dict[str, EntityPattern] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    id: str
    type: str
    severity: str
    message: str
    applies_to: tuple[str, ...] = ()
    min: float | None = None
    max: float | None = None
    unit: str | None = None
    metric_a: str | None = None
    metric_b: str | None = None
    relation: str | None = None
    match_on: tuple[str, ...] = ()


def _yaml(path: str):
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def pack_from(spec: dict) -> Pack:
    def column(c: dict) -> ColumnRule:
        return ColumnRule(**{**c, "match": tuple(c["match"])})

    kinds = tuple(
        TableType(name, tuple(t.get("caption_patterns", ())), tuple(t.get("header_signature", ())), t.get("min_signature_overlap", 1), tuple(map(column, t.get("columns", ()))))
        for name, t in spec.get("table_types", {}).items()
    )
    return Pack(spec["pack"], spec["version"], kinds, {k: entity_pattern(p) for k, p in spec.get("entity_patterns", {}).items()})


def entity_pattern(p: dict) -> EntityPattern:
    return EntityPattern(p["regex"], p["normalise"], tuple(p["groups"]), tuple(p.get("upper", ())), p.get("aliases", {}))


def load_pack(path: str) -> Pack:
    return pack_from(_yaml(path))


def rules_from(spec: dict) -> list[Rule]:
    known = Rule.__dataclass_fields__
    return [Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items() if k in known}) for r in spec["rules"]]


def load_rules(path: str) -> list[Rule]:
    return rules_from(_yaml(path))


def load_metrics(path: str) -> list[str]:
    return sorted(_yaml(path)["metrics"])


# The default pack's names, patterns, units and bounds, as the data it reads has them. "vm%" stands before
# "m%", which it contains, so that the first match is the right one.

_METRIC = {"role": "metric", "unit_from_header": True, "stat_from_header": True}

GEOLOGY = pack_from(
    {
        "pack": "geological_report",
        "version": 4,
        "table_types": {
            "seam_range_summary_table": {
                "caption_patterns": ["range of seam thickness", "seam.*proximate analysis"],
                "header_signature": ["seam name", "range", "thickness", "gcv", "grade"],
                "min_signature_overlap": 3,
                "columns": [
                    {"match": ["seam name"], "role": "entity", "entity_type": "seam"},
                    {"match": ["effective thickness"], "metric_key": "seam_thickness_net", "expect_unit": "m", **_METRIC},
                    {"match": ["seam thickness"], "metric_key": "seam_thickness_gross", "expect_unit": "m", **_METRIC},
                    {"match": ["ash"], "metric_key": "coal_ash_pct", "expect_unit": "%", **_METRIC},
                    {"match": ["vm%"], "metric_key": "coal_vm_pct", "expect_unit": "%", **_METRIC},
                    {"match": ["m%"], "metric_key": "coal_moisture_pct", "expect_unit": "%", **_METRIC},
                    {"match": ["fc%"], "metric_key": "coal_fc_pct", "expect_unit": "%", **_METRIC},
                    {"match": ["gcv"], "metric_key": "coal_gcv", "expect_unit": "kcal/kg", **_METRIC, "unit_from_header": False},
                    {"match": ["grade"], "metric_key": "coal_grade_band", "value_type": "categorical", **_METRIC, "unit_from_header": False},
                ],
            },
            "seam_thickness_table": {
                "caption_patterns": ["seam[- ]wise thickness", "thickness of seams?"],
                "header_signature": ["seam", "borehole", "gross", "net", "thickness", "bh no"],
                "min_signature_overlap": 2,
                "columns": [
                    {"match": ["seam"], "role": "qualifier", "qualifier_key": "seam"},
                    {"match": ["bh no", "borehole", "bore hole"], "role": "entity", "entity_type": "borehole"},
                    {"match": ["gross"], "role": "metric", "metric_key": "seam_thickness_gross", "expect_unit": "m", "unit_from_header": True},
                    {"match": ["net"], "role": "metric", "metric_key": "seam_thickness_net", "expect_unit": "m", "unit_from_header": True},
                    {"match": ["ash"], "role": "metric", "metric_key": "coal_ash_pct", "expect_unit": "%"},
                    {"match": ["gcv", "calorific"], "role": "metric", "metric_key": "coal_gcv", "expect_unit": "kcal/kg"},
                    {"match": ["grade"], "role": "metric", "metric_key": "coal_grade_band", "value_type": "categorical"},
                ],
            },
        },
        "entity_patterns": {
            "borehole": {"regex": r"\b(CSM\s*I\s*&\s*II|MSM|SKM|SGT)[\s.\-]+(\d{1,4})\b", "normalise": "{prefix}-{number}", "groups": ["prefix", "number"], "upper": ["prefix"], "aliases": {"prefix": {"MSM": "MSM", "CSM": "CSM I&II"}}},
            "seam": {"regex": r"\b([IVXL]+[A-Z]?)\s*(Top|Middle|Bottom|Combined)?\b", "normalise": "{roman} {position}", "groups": ["roman", "position"], "upper": ["roman"]},
        },
    }
)

GEOLOGY_RULES = rules_from(
    {
        "rules": [
            {"id": "thickness_range", "type": "range", "applies_to": ["seam_thickness_gross", "seam_thickness_net"], "min": 0, "max": 50, "unit": "m", "severity": "block", "message": "{metric_key} of {value} lies outside {min} to {max} {unit}"},
            {"id": "pct_range", "type": "range", "applies_to": ["coal_ash_pct", "coal_moisture_pct", "coal_vm_pct", "coal_fc_pct"], "min": 0, "max": 100, "severity": "block", "message": "{metric_key} of {value} is no percentage"},
            {"id": "net_le_gross", "type": "pair", "metric_a": "seam_thickness_net", "metric_b": "seam_thickness_gross", "relation": "le", "match_on": ["entity_id", "value_kind"], "severity": "block", "message": "{entity_id}: net of {a_value} cannot be more than gross of {b_value}"},
            {"id": "ash_gcv_inverse", "type": "pair", "metric_a": "coal_ash_pct", "metric_b": "coal_gcv", "relation": "high_ash_high_gcv_implausible", "match_on": ["entity_id", "value_kind"], "severity": "warn", "message": "{entity_id}: a heat of {b_value} does not go with {a_value} of ash"},
        ]
    }
)

GEOLOGY_METRICS = ["coal_ash_pct", "coal_fc_pct", "coal_gcv", "coal_grade_band", "coal_moisture_pct", "coal_vm_pct", "seam_thickness_gross", "seam_thickness_net"]
