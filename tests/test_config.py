import pytest

from counterpoise import MatchConfig, SamplingConfig


@pytest.mark.parametrize(
    ("change", "said"),
    [
        ({"match_vars": []}, "non-empty"), ({"match_vars": ["a", "a"]}, "duplicates"), ({"stratify_vars": ["a", "a"]}, "duplicates"), ({"stratify_vars": ["z"]}, "subset"),
        ({"monitor_vars": ["m", "m"]}, "duplicates"), ({"monitor_vars": ["a"]}, "overlap"), ({"weights": {"z": 1}}, "weights"), ({"treatment_col": ""}, "required"),
        ({"treatment_col": "a"}, "treatment_col"), ({"n": 0}, "n must"), ({"tolerance": 1.5}, "tolerance"), ({"min_control_pool_size": 0}, "min_control_pool_size"),
        ({"min_control_ratio": 0}, "min_control_ratio"), ({"n_bins": 1}, "n_bins"), ({"max_candidates_per_target": 0}, "max_candidates"), ({"id_col": "t"}, "id_col"),
        ({"js_threshold": -1}, "js_threshold"), ({"ks_threshold": 2}, "ks_threshold"), ({"n_workers": 0}, "n_workers"), ({"duckdb_threads": 0}, "duckdb_threads"),
    ],
)
def test_wrong_match_settings(change, said):
    with pytest.raises(ValueError, match=said):
        MatchConfig(**({"match_vars": ["a", "b"], "treatment_col": "t"} | change))


def test_grouping_and_weights():
    cfg = MatchConfig(["a", "b"], "t", weights={"a": 2}, stratify_vars=["b"])
    assert cfg.grouping_vars == ("b",) and cfg.weight_for("a") == 2.0 and cfg.weight_for("b") == 1.0
    assert MatchConfig(["a", "b"], "t").grouping_vars == ("a", "b")


@pytest.mark.parametrize(
    "change",
    [
        {"sample_size": 0}, {"sample_size": True}, {"sample_size": 1.5}, {"n_bins": 1}, {"max_report_rows": 0}, {"label_col": ""}, {"label_col": 3}, {"stratify_vars": "x"}, {"stratify_vars": ["x", "x"]},
        {"check_vars": [""]}, {"ks_threshold": float("nan")}, {"js_threshold": 1.1}, {"ks_threshold": True}, {"check_by_label": 1, "label_col": "y"}, {"check_by_label": True}, {"random_state": -1},
        {"random_state": 1 << 63}, {"random_state": False}, {"duckdb_threads": 0},
    ],
)
def test_wrong_sampling_settings(change):
    with pytest.raises(ValueError):
        SamplingConfig(**({"sample_size": 5} | change))


def test_sampling_features():
    cfg = SamplingConfig(5, "y", ["x", "y", "z"], ["z", "w"])
    assert cfg.features == ("x", "z", "w") and 0 <= cfg.random_state < 1 << 63
