from proofmill.operators import audits as AU


def test_grouped_findings_move_no_whole_rows(spark):
    """rows were joined whole with six grouped tables."""
    cols = "row_key string, source string, record_id string, subject_id string, endpoint string, relation string, value_text string, unit string, description string, method string, target_id string"
    rows = [
        ("1", "a", "r", "s", "e", "=", "1", "nM", "d", "m", "t"),
        ("2", "a", "r", "s", "e", "=", "1", "nM", "d", "m", "t"),
        ("3", "a", "r", "s", "e", "=", "9000", "nM", "d", "x", "t"),
        ("4", "a", "", "s", "e", "=", "5", "nM", "q", "m", "t"),
        ("5", "a", "", "s", "f", "=", "5", "nM", "q", "m", "t"),
    ]
    p = AU.AuditPolicy()
    base = AU._base(spark.createDataFrame(rows, cols), p, "row_key")
    found = AU.grouped_findings(base, p, "row_key")
    got = sorted((r.row_key, r.code) for r in found.collect())
    want = [(k, "duplicate_identifier") for k in "123"] + [(k, "exact_duplicate_row") for k in "12"] + [(k, "conflicting_identifier") for k in "123"]
    want += [(k, "assay_metadata_conflict") for k in "123"] + [(k, "conflicting_repeated_measurement") for k in "1234"]
    assert got == sorted(want)
