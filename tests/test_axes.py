from kvern.operators import rules
from kvern.plans import catalogue


def test_all_one_parameter_sweeps_of_the_reference():
    configs = catalogue.axis_configs()
    assert len(catalogue.AXES) == 26 and len({n for n, _, _ in configs}) == len(configs) == sum(len(a[2]) for a in catalogue.AXES) == 155
    assert {p for _, _, c in configs for p in rules.validated(c)} >= {"conf_threshold", "min_long_side", "max_elongation", "max_letters", "require_fnr_candidate", "reject_decimal", "reject_00_run", "reject_orgnr", "reject_org_ord", "line_veto", "reject_run_6_10", "reject_decimal_gap"}
    by_name = {n: c for n, _, c in configs}
    assert by_name["conf_threshold=0.3"] == {"min_elongation": 1.5, "max_height": 50, "max_width": 120, "conf_threshold": 0.3}
    assert by_name["reject_decimal + ocr_conf_exempt=off"] == {"reject_decimal": 1, "rec_veto": 0.98}
    gates = {"rec_veto", "line_veto", "ocr_conf_exempt", "conf_threshold"}
    assert [n for n, c in by_name.items() if not set(c) - gates] == ["reject_run_6_10=off", "without_text_conf=off"]
    assert catalogue.THRESHOLDS == (0.15, 0.25, 0.32, 0.4, 0.5, 0.7, 0.9)
