"""Headers, continuation, typing and gates on small grids."""

import pytest
from pyspark.sql import functions as F

from orewright import config, schemas
from orewright.config import GEOLOGY, GEOLOGY_METRICS, GEOLOGY_RULES, EntityPattern, Rule
from orewright.functions.text import parse_page_range, strip_accents
from orewright.operators import assay, headers, typing
from orewright.shared import cut

#: A grid of two header rows with a spanning text, a footnote mark, a net above its gross, and a name with a dot.
SAMPLE = [
    ["Seam", "Bore hole", "Thickness (m)", "Thickness (m)", "Ash %", "Calorific value", "Grade"],
    ["Seam", "Bore hole", "Gross", "Net", "Ash %", "Calorific value", "Grade"],
    ["II Bottom", "SGT-201", "5.06", "4.77", "28.6†", "4890", "G7"],
    ["II Bottom", "SGT-207", "4.40", "5.15", "30.4", "4760", "G8"],
    ["IV Middle", "SGT.211", "7.88", "7.52", "27.9", "4795", "G8"],
    ["IV Middle", "SGT-203", "8.95", "8.61", "29.2", "4835", "G7"],
]


def cells_of(spark, grid, element="t0", doc="d", page=1, boxes=None):
    rows = []
    for r, row in enumerate(grid):
        for c, text in enumerate(row):
            l, right = (boxes or {}).get((r, c), (c * 50.0, c * 50.0 + 50) if boxes is None else (None, None))
            box = None if l is None else (page, float(l), 0.0, float(right), 0.0, "TOPLEFT")
            rows.append((doc, element, r, c, text, r < 2, 0.95, None, box))
    return spark.createDataFrame(rows, schemas.schema("ast_cell"))


def table_of(spark, grid, element="t0", doc="d", page=1):
    return spark.createDataFrame([(doc, element, page, len(grid), len(grid[0]), (page, 0.0, 100.0, 400.0, 200.0, "TOPLEFT"), 1, 0.95)], schemas.schema("ast_table"))


def texts_of(spark, *texts, doc="d", page=1):
    rows = [(doc, f"p{page}-text-{i}", page, i, t, (page, 0.0, b - 5, 100.0, b, "TOPLEFT"), 0.95) for i, (t, b) in enumerate(texts)]
    return spark.createDataFrame(rows, schemas.schema("ast_text"))


def sample(spark):
    texts = texts_of(spark, ("Seam wise thickness in the bore holes", 90.0))
    return typing.emit_candidates(table_of(spark, SAMPLE), texts, cells_of(spark, SAMPLE), GEOLOGY)


def test_sample_candidates_and_gates(spark):
    c = sample(spark).withColumn("reeval_count", F.lit(0)).cache()
    assert c.count() == 20
    got = {(r.entity_id, r.metric_key): r for r in c.collect()}
    assert got["SGT-201", "coal_ash_pct"].value_text == "28.6"
    assert got["SGT-211", "seam_thickness_net"].unit == "m"
    assert got["SGT-201", "coal_grade_band"].value is None
    judged = assay.run_gates(c, assay.findings(c, GEOLOGY_RULES, ("doc_id",)), GEOLOGY_METRICS).cache()
    assert {r.state: r.n for r in assay.state_counts(judged).collect()} == {"auto_passed": 7, "pending_review": 12, "soft_rejected": 1}
    bad = judged.where("state = 'soft_rejected'").first()
    assert (bad.entity_id, bad.failed_gate, len(bad.gate_results)) == ("SGT-207", "G5", 5)
    assert not bad.gate_results[-1].passed


def test_spanning_headers(spark):
    grid = [["Seam", "Range Thickness (m)", None, "Grade", ""], ["Seam", "Min", "Max", "Grade", ""], ["IV", "1.2", "1.8", "7", ""]]
    boxes = {(0, 0): (0, 50), (0, 1): (50, 150), (0, 3): (150, 200), (1, 0): (0, 50), (1, 1): (50, 100), (1, 2): (100, 150), (1, 3): (150, 200)}
    cells = cells_of(spark, grid, boxes=boxes)
    counts = headers.header_counts(cells)
    assert counts.first().header_rows == 2
    chains = {r.col: r.chain for r in headers.header_chains(cells, counts).collect()}
    assert chains[1] == ["Range Thickness (m)", "Min"] and chains[2] == ["Range Thickness (m)", "Max"] and chains[0] == ["Seam"]
    plain = cells_of(spark, grid, boxes={(9, 9): (0, 0)})
    assert {r.col: r.chain for r in headers.header_chains(plain, counts).collect()}[2] == ["Max"]


@pytest.mark.parametrize(("second_page", "head", "tables"), [(16, "Gross", 1), (17, "Gross", 2), (16, "Net", 2)])
def test_continuation(spark, second_page, head, tables):
    a, b = [["Seam", "Gross"], ["IV", "1.8"], ["III", "3.4"]], [["Seam", head], ["II", "2.0"]]
    cells = cells_of(spark, a, "p15-t0", page=15).union(cells_of(spark, b, f"p{second_page}-t0", page=second_page))
    both = table_of(spark, a, "p15-t0", page=15).union(table_of(spark, b, f"p{second_page}-t0", page=second_page))
    merged, moved = headers.merge_continued(both, cells, headers.header_counts(cells))
    assert merged.count() == tables
    if tables == 1:
        last = moved.where("text = 'II'").first()
        assert (last.row, last.element_id, last.bbox.page_no) == (3, "p15-t0", 16)
        assert merged.first().num_rows == 4


def test_row_groups_fold(spark):
    grid = [["Seam Name", "Seam Thickness (m) range gcv grade"], ["IV", "1.8"], ["", "MSM-17"], ["III", "3.4"]]
    c = typing.emit_candidates(table_of(spark, grid), texts_of(spark, ("Range of seam thickness", 90.0)), cells_of(spark, grid), GEOLOGY).collect()
    by = {r.entity_id: r for r in c}
    assert set(by) == {"IV", "III"}
    assert by["IV"].qualifiers["source_boreholes"] == "MSM-17" and "source_boreholes" not in by["III"].qualifiers


def test_moisture_and_volatile_matter_bind_apart(spark):
    grid = [["Seam Name", "VM%", "M%"], ["IV", "20.1", "5.2"]]
    c = typing.emit_candidates(table_of(spark, grid), texts_of(spark, ("Range of seam thickness", 90.0)), cells_of(spark, grid), GEOLOGY).collect()
    assert {r.metric_key: r.value_text for r in c} == {"coal_vm_pct": "20.1", "coal_moisture_pct": "5.2"}


def test_out_of_range_message_has_its_unit(spark):
    c = sample(spark).withColumn("value", F.lit(999).cast("decimal(38,18)")).withColumn("value_text", F.lit("999"))
    found = assay.range_findings(c, GEOLOGY_RULES).where("rule_id = 'thickness_range'").first()
    assert found.message.endswith("of 999 lies outside 0 to 50 m")


def test_reeval_recovers_with_wider_pattern(spark):
    narrow = {**GEOLOGY.entity_patterns, "borehole": EntityPattern(r"\b(SGT)[\s-]+(\d{1,4})\b", "{prefix}-{number}", ("prefix", "number"))}
    pack = type(GEOLOGY)(GEOLOGY.name, 2, GEOLOGY.table_types, narrow)
    c = cut(typing.emit_candidates(table_of(spark, SAMPLE), texts_of(spark, ("Seam-wise thickness", 90.0)), cells_of(spark, SAMPLE), pack).withColumn("reeval_count", F.lit(0)))
    before = cut(assay.run_gates(c, assay.findings(c, GEOLOGY_RULES), GEOLOGY_METRICS))
    after = cut(assay.reeval(before, GEOLOGY_RULES, GEOLOGY_METRICS, GEOLOGY))
    lost = before.where("entity_raw = 'SGT.211'")
    assert lost.where("state = 'soft_rejected'").count() == 5
    again = after.where("entity_raw = 'SGT.211'").collect()
    assert {r.entity_id for r in again} == {"SGT-211"} and {r.reeval_count for r in again} == {1}
    assert after.count() == before.count()


def test_pair_findings_count_what_a_plain_comparison_counts(spark):
    """Every relation, null keys, repeated values and nulls in values, against all pairs."""
    import random
    from decimal import Decimal

    r = random.Random(1)
    rows = [(f"c{i}", r.choice(["x", "y", None]), r.choice("ab"), None if r.random() < 0.1 else Decimal(r.choice([1, 2, 3, 41, 50, 5500, 6000])), r.choice(["d1", None])) for i in range(120)]
    df = spark.createDataFrame([(*x, None, {}) for x in rows], "candidate_id string, entity_id string, metric_key string, value decimal(38,18), doc_id string, value_text string, qualifiers map<string,string>")
    plain = {"le": lambda a, b: a <= b, "lt": lambda a, b: a < b, "ge": lambda a, b: a >= b, "gt": lambda a, b: a > b, "eq": lambda a, b: a == b, "high_ash_high_gcv_implausible": lambda a, b: not (a > 40 and b > 5500)}
    rules = [Rule(k, "pair", "warn", "{b_value}", metric_a="a", metric_b="b", relation=k, match_on=("entity_id",)) for k in plain]
    got = {(x.candidate_id, x.rule_id): (x.n, float(x.message)) for x in assay.pair_findings(df, rules, ("doc_id",)).collect()}
    want = {}
    for i, e, m, v, d in rows:
        for name, holds in plain.items():
            broken = [w for _, e2, m2, w, d2 in rows if m == "a" and m2 == "b" and (e, d) == (e2, d2) and v is not None and w is not None and not holds(v, w)]
            if broken:
                want[i, name] = (len(broken), broken)
    assert got.keys() == want.keys() and all(got[k][0] == n and got[k][1] in b for k, (n, b) in want.items())


def test_packs_rules_and_metrics_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "pack.yaml").write_text(r"""
pack: yards
version: 3
table_types:
  yard_table:
    caption_patterns: ["yards? of"]
    header_signature: [yard, depth]
    min_signature_overlap: 2
    columns:
      - {match: [yard], role: entity, entity_type: yard}
      - {match: [depth], role: metric, metric_key: depth, expect_unit: m, unit_from_header: true, stat_from_header: true}
entity_patterns:
  yard: {regex: '\b(Y)-(\d+)', normalise: '{mark}{number}', groups: [mark, number], upper: [mark]}
""")
    (tmp_path / "rules.yaml").write_text("rules:\n  - {id: deep, type: range, applies_to: [depth], min: 0, max: 9, unit: m, severity: block, message: '{value} is no depth'}\n")
    (tmp_path / "metrics.yaml").write_text("metrics:\n  depth: {unit: m}\n")
    pack, rules, metrics = config.load_pack(str(tmp_path / "pack.yaml")), config.load_rules(str(tmp_path / "rules.yaml")), config.load_metrics(str(tmp_path / "metrics.yaml"))
    grid = [["Yard", "Depth (ft)"], ["Yard", "max"], ["y-7", "8"], ["Y-9", "12"]]
    c = typing.emit_candidates(table_of(spark, grid), texts_of(spark, ("Yards of the east", 90.0)), cells_of(spark, grid), pack).withColumn("reeval_count", F.lit(0))
    got = {x.entity_id: x for x in assay.run_gates(c, assay.findings(c, rules), metrics).collect()}
    assert {(k, x.value_kind, x.unit, x.state) for k, x in got.items()} == {("Y7", "max", "ft", "auto_passed"), ("Y9", "max", "ft", "soft_rejected")}
    assert got["Y9"].failure_reason == "12 is no depth"


def test_pages_and_accents(spark):
    assert parse_page_range("14-19") == (14, 19) and parse_page_range("7") == (7, 7)
    assert spark.range(1).select(strip_accents(F.lit("Éclair ñ")).alias("x")).first().x == "Eclair n"


def test_questions_meet_facts_by_metric_and_entity(spark):
    """Not by metric alone, which is as many pairs as questions times facts; questions on any entity meet all of their metric."""
    from orewright.operators.agents import evidence_of

    facts = spark.createDataFrame([("f1", "m", "e1", 1), ("f2", "m", "e2", 2), ("f3", "n", "e1", 3), ("f4", "m", None, 4), ("f5", None, "e1", 5)], "fact_id string, metric_key string, entity_id string, value int")
    facts = facts.selectExpr("*", "string(value) AS value_text", "'u' AS unit", "'p' AS period")
    asked = spark.createDataFrame([("q1", "m", "e1"), ("q2", "m", None), ("q3", "n", "e2"), ("q4", "n", None), ("q5", None, "e1")], "question_id string, metric_key string, entity_id string").withColumn("title", F.lit("t"))
    found = evidence_of(asked, facts)
    assert sorted((x.question_id, x.fact_id, x.entity_id) for x in found.collect()) == [("q1", "f1", "e1"), ("q2", "f1", "e1"), ("q2", "f2", "e2"), ("q2", "f4", None), ("q4", "f3", "e1")]
    assert " OR " not in found._jdf.queryExecution().optimizedPlan().toString()
