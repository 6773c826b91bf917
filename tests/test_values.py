import hashlib
import re

from __spark_entry__ import SMOKE_DIR
from pyspark.sql import functions as F

from proofmill.functions import text as T
from proofmill.functions import values as V
from proofmill.operators import features as FT
from proofmill.operators import gates as G
from proofmill.operators import joins as J
from proofmill.plans.bindings import Tables


def one(spark, expr, *vals):
    df = spark.createDataFrame([vals], ", ".join(f"c{i} string" for i in range(len(vals))))
    return df.select(expr.alias("x")).first().x


def test_scalars(spark):
    for text, want in [("<1,000", 1000.0), ("> 3.5e2", 350.0), ("not reported", None), ("1e999", None)]:
        assert one(spark, V.parse_numeric("c0"), text) == want
    for u, f in [("nM", 1.0), ("nmol/L", 1.0), ("µM", 1000.0), ("mol L^-1", 1e9), ("", None), ("mg/mL", None)]:
        assert one(spark, V.unit_factor("c0"), u) == f
    assert one(spark, V.extract_relation("c0", "c1"), "<5", "") == "<"
    assert one(spark, V.extract_relation("c0", "c1"), "<5", " =< ") == "<="
    assert one(spark, V.extract_relation("c0", "c1"), "≥5", None) == ">="
    assert one(spark, V.extract_relation("c0", "c1"), "5", "odd") == "odd"
    assert one(spark, T.extract_year("c0"), "seen 2004; 1998") == 1998
    assert abs(one(spark, V.p_value(F.lit(100.0)), "x") - 7.0) < 1e-12


def test_qualified_values(spark):
    cases = {
        "5": ("parsed", 5.0, "=", "none"), "≤ 3": ("parsed", 3.0, "<=", "left"), "∞": ("unbounded_right_censored", None, ">", "right"),
        "5 to 2": ("interval", None, "~", "interval"), "nd": ("missing", None, "not_reported", "missing"), "abc": ("unparsed", None, "not_reported", "unknown"),
    }
    df = V.with_qualified(spark.createDataFrame([(k,) for k in cases], "v string"), "v", "q")
    got = {r.v: (r.q.status, r.q.value, r.q.relation, r.q.censoring) for r in df.collect()}
    assert got == cases
    r = df.where("v = '5 to 2'").first().q
    assert (r.lower_bound, r.upper_bound) == (2.0, 5.0)


def test_bounds_invert_on_p_scale(spark):
    rows = [("1", "a", "s1", "r1", "e", "f", ">", "100", "nM", "a", "d", 2000), ("2", "a", "s1", "r2", "e", "f", "<", "100", "nM", "a", "d", 2000), ("3", "a", "s1", "r3", "e", "f", "=", "5", "furlong", "a", "d", 2000)]
    cols = "row_key string, source string, subject_id string, record_id string, endpoint string, family string, relation string, value_text string, unit string, assay_id string, document_id string, yr int"
    d = G.gate(G.normalize_values(spark.createDataFrame(rows, cols)), core_endpoints=("e",))
    got = {r.row_key: r for r in d.collect()}
    assert got["1"].p_upper_bound == 7.0 and got["1"].p_lower_bound is None
    assert got["2"].p_lower_bound == 7.0 and got["2"].p_upper_bound is None
    assert got["3"].value_scaled is None and got["3"].exclusion_reason == "unsupported_unit" and not got["3"].is_eligible


MEASUREMENTS = "row_key string, source string, subject_id string, record_id string, endpoint string, family string, relation string, value_text string, unit string, assay_id string, document_id string, yr int"


def test_parsing_compiles_to_methods_that_the_jvm_compiles(spark, capsys):
    huge = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.codegen.hugeMethodLimit")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        Tables(spark, SMOKE_DIR).normalized.explain("codegen")
    finally:
        for k, v in huge.items():
            spark.conf.set(k, v)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_hashed_ngrams_take_characters_outside_the_first_plane_whole(spark):
    texts = ["a\U0001F600b\U0001F601cd", " ab\ncde ", "", None, "x"]
    grams = [{t[i : i + n] for t in [(x or "").strip(" ")] for n in (2, 3, 4) for i in range(len(t) - n + 1)} for x in texts]
    want = [sorted({int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 1024 for g in gs}) for gs in grams]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [r.bits for r in FT.hashed_ngrams(d, "text").orderBy("i").collect()] == want


def test_gate_flags_equal_those_of_the_whole_table(spark):
    rows = []
    for i in range(60):  # a row and the second next with its j are duplicates, the one between has another value
        j = i % 20
        record = [f"R{j % 9}", f" R{j % 9}", "", None][j % 4]
        rows.append((f"k{i:02d}", "ab"[j % 2], f"s{j % 3}", record, "e", "f", "=", str(1 + i // 20 % 2), "nM", "a", ["d", None][j % 2], 2000))
    d = G.normalize_values(spark.createDataFrame(rows, MEASUREMENTS))
    whole = G.flag_record_conflicts(G.flag_duplicates(G.measurement_ids(d), fields=("measurement_id",)))
    flags = ("row_key", "measurement_id", "is_duplicate", "record_conflict")
    want = sorted(tuple(r) for r in whole.select(*flags).collect())
    assert any(r[2] for r in want) and any(r[3] for r in want)
    assert sorted(tuple(r) for r in G.gate(d, core_endpoints=("e",)).select(*flags).collect()) == want


def test_mirrors_need_eligible_preferred(spark):
    rows = [("1", "alpha", "x", True), ("2", "beta", "x", True), ("3", "beta", "x", True), ("4", "alpha", "y", False), ("5", "beta", "y", True)]
    d = spark.createDataFrame(rows, "row_key string, source string, subject_id string, is_eligible boolean")
    d = d.withColumns({"endpoint": F.lit("e"), "family": F.lit("f"), "relation": F.lit("="), "p_value": F.lit(7.0)})
    m = {r.row_key: r for r in G.link_mirrors(d, priority=("alpha", "beta")).collect()}
    assert not m["1"].is_mirror_redundant and m["2"].is_mirror_redundant and m["3"].is_mirror_redundant
    assert not m["5"].is_mirror_candidate and not m["4"].is_mirror_candidate


def test_paired_and_panel_explode(spark):
    d = spark.createDataFrame([(1, "2/5 | 1/3", "s1, s2"), (2, "2/5 | 1/3", "s1"), (3, "0.37", "s1, s2"), (4, "x", "")], "i int, v string, s string")
    got = {(r.i, r.position): (r.value, r.locator, r.pairing) for r in J.expand_evidence(d, "v", "s").collect()}
    assert got[(1, 1)] == ("1/3", "s2", "resolved") and got[(2, 0)] == ("2/5", None, "unresolved")
    assert got[(3, 0)] == ("0.37", "s1 | s2", "resolved") and got[(4, 0)][2] == "unresolved"
    p = J.panel_rows(spark.createDataFrame([("15%@10uM and >45%@30 µM",)], "t string"), "t").collect()
    assert [(r.relation, r.response, r.concentration) for r in p] == [("=", 15.0, 10.0), (">", 45.0, 30.0)]
