import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trialmesh.functions import text
from trialmesh.operators import identity, quality, schema
from trialmesh.sources import tables


def base(**changes):
    row = dict(
        candidate_id="R2-05", IL1="MC3", IL1_molpct=50.0, IL2=None, IL2_molpct=0.0, Phospholipid="DSPC", HL_molpct=10.0, CHOL_molpct=38.5,
        PEG="DMG-PEG2000", PEG_molpct=1.5, NP_ratio=6.0, PDI=0.2, particle_size=100.0,
    )
    return row | changes


SCHEMA = (
    "candidate_id string, IL1 string, IL1_molpct double, IL2 string, IL2_molpct double, Phospholipid string, HL_molpct double, CHOL_molpct double, "
    "PEG string, PEG_molpct double, NP_ratio double, PDI double, particle_size double"
)


def frame(spark, rows):
    return spark.createDataFrame([Row(**r) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    "change, reason",
    [
        ({}, ""),
        ({"IL1": "XX"}, "unknown_IL1"),
        ({"IL1": None}, "unknown_IL1"),
        ({"IL2": "XX"}, "unknown_IL2"),
        ({"Phospholipid": None}, "unknown_phospholipid"),
        ({"PEG": "?"}, "unknown_PEG"),
        ({"IL1_molpct": 30.0}, ""),
        ({"IL1_molpct": 29.99}, "molar_sum_outside_80_120"),
        ({"IL1_molpct": 70.0}, ""),
        ({"IL1_molpct": 70.01}, "molar_sum_outside_80_120"),
        ({c: None for c in ("IL1_molpct", "IL2_molpct", "HL_molpct", "CHOL_molpct", "PEG_molpct")}, "molar_sum_outside_80_120"),
        ({"IL1": "XX", "PEG": "?"}, "unknown_IL1;unknown_PEG"),
    ],
)
def test_mixture_reasons(spark, change, reason):
    kept, removed = quality.validate_rows(frame(spark, [base(**change)]))
    assert kept.count() == (reason == "")
    assert [r["removal_reason"] for r in removed.collect()] == ([reason] if reason else [])


@pytest.mark.parametrize(
    "change, complete, reason",
    [
        ({"PDI": 0.5}, True, ""),
        ({"PDI": 0.51}, True, "PDI>0.5"),
        ({"particle_size": 30.0}, True, ""),
        ({"particle_size": 300.0}, True, ""),
        ({"particle_size": 300.1}, True, "size_outside_30.0_300.0nm"),
        ({"PDI": None}, True, "PDI_missing"),
        ({"PDI": None}, False, ""),
        ({"PDI": 0.9, "particle_size": None}, True, "PDI>0.5;size_missing"),
    ],
)
def test_qc_reasons(spark, change, complete, reason):
    _, removed = quality.qc_filter(frame(spark, [base(**change)]), require_complete=complete)
    assert [r["removal_reason"] for r in removed.collect()] == ([reason] if reason else [])


def test_qc_without_columns(spark):
    rows = frame(spark, [base()]).drop("PDI", "particle_size")
    assert quality.qc_filter(rows)[0].count() == 1
    with pytest.raises(ValueError):
        quality.qc_rules(rows.columns, strict=True)


def test_funnel_checks_final_size(spark):
    rows = spark.range(10)
    stages = {"all": F.lit(False), "even": F.col("id") % 2 == 1}
    assert [r["n_rows"] for r in quality.population_funnel(rows, stages, 5).orderBy("stage_order").collect()] == [10, 5]
    with pytest.raises(ValueError):
        quality.population_funnel(rows, stages, 6)


@pytest.mark.parametrize(
    "raw, name",
    [
        ("SM-102", "SM102"), ("sm_102", "SM102"), ("CKK E12 (CCK12)", "CKK-E12"), ("odd (MC3)", "MC3"), ("dspc", "DSPC"), ("无", None), (" - ", None),
        ("NaN", None), ("peg-mannose", "PEG-Mannose"), ("Unlisted", "Unlisted"), (None, None),
    ],
)
def test_canonical_name(spark, raw, name):
    df = spark.createDataFrame([(raw,)], "n string")
    assert df.select(text.canonical_name(F.col("n"))).first()[0] == name


@pytest.mark.parametrize("raw, value", [("45 %", 45.0), ("abc", None), ("", None), ("-", None), ("1e3", 1000.0), ("x-2.5y", -2.5), (None, None), ("e", None)])
def test_lenient_number(spark, raw, value):
    df = spark.createDataFrame([(raw,)], "n string")
    assert df.select(text.to_number_lenient(F.col("n"))).first()[0] == value


@pytest.mark.parametrize("raw, value", [(" 12.5 ", 12.5), ("45 %", None), ("5d", None), ("nan", None), ("-3", -3.0)])
def test_strict_number(spark, raw, value):
    df = spark.createDataFrame([(raw,)], "n string")
    assert df.select(text.to_number(F.col("n"))).first()[0] == value


@pytest.mark.parametrize(
    "label, highest, prefix",
    [("R1-17 (R3-28)", "R3", "R1"), ("17", "R1", "R1"), ("17.0", "R1", "R1"), ("r 2-5", "R2", "R2"), ("abc", "UNKNOWN", "UNKNOWN"), (None, "UNKNOWN", "UNKNOWN")],
)
def test_round_from_id(spark, label, highest, prefix):
    df = spark.createDataFrame([(label,)], "n string")
    row = df.select(text.round_from_id(F.col("n")), text.round_from_id(F.col("n"), True)).first()
    assert tuple(row) == (highest, prefix)


def test_signature_ignores_order_and_small_noise(spark):
    rows = [
        base(IL1="MC3", IL1_molpct=20.0, IL2="SM102", IL2_molpct=30.0),
        base(IL1="SM102", IL1_molpct=30.0, IL2="MC3", IL2_molpct=20.00001),
        base(IL1="SM102", IL1_molpct=30.0, IL2="MC3", IL2_molpct=20.001),
        base(NP_ratio=None),
    ]
    found = [r[0] for r in identity.add_signature(frame(spark, rows)).select("formulation_signature").collect()]
    assert found[0] == found[1] != found[2]
    assert found[0] == "IL:MC3:20.0000|IL:SM102:30.0000|HL:DSPC:10.0000|CHOL:38.5000|PEG:DMG-PEG2000:1.5000|NP:6.0000"
    assert found[3] == "IL:MC3:50.0000|HL:DSPC:10.0000|CHOL:38.5000|PEG:DMG-PEG2000:1.5000"


def test_standardize_detects_id_and_fills_defaults(spark):
    rows = [(f"R3-{i:02d}", "SM-102", "45", None) for i in range(25)]
    raw = spark.createDataFrame(rows, "`0` string, `Ionizable_Lipid_1` string, ` il1_MolPct ` string, `磷脂` string")
    out, sources = schema.standardize_columns(raw)
    assert sources["candidate_id"] == "0" and sources["Phospholipid"] == "磷脂"
    row = out.orderBy("candidate_id").first()
    assert (row["candidate_id"], row["IL1"], row["IL1_molpct"], row["IL2_molpct"], row["NP_ratio"], row["Round"]) == ("R3-00", "SM102", 45.0, 0.0, None, None)
    unnamed, _ = schema.standardize_columns(raw.drop("0"))
    assert unnamed.agg(F.min("candidate_id")).first()[0] == "sample_001"


def test_target_is_locked(spark):
    df = spark.createDataFrame([("1",), (None,), ("0",)], "`Response` string")
    with pytest.raises(ValueError):
        schema.attach_target(df, "response normalized", "y")
    values = [r["y"] for r in schema.attach_target(df, "response", "y", "log10").collect()]
    assert values == [0.0, pytest.approx(-12.0)]


def test_group_column_and_vectors(spark):
    df = spark.createDataFrame([(i, f"t{i % 4}", f"u{i}") for i in range(40)], "n int, task string, unique string")
    assert schema.detect_group_column(df) == "task"
    assert schema.detect_vector_columns(["fp_2", "bit-0", "Morgan 1", "x"], minimum=3) == ["bit-0", "Morgan 1", "fp_2"]
    assert schema.detect_vector_columns(["fp_0", "fp_1"]) == []


def test_dedup_with_one_dominant_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id", (F.col("id") * 2).alias("v"))
    out = identity.dedup_keep_first(rows, ["k"], ["id"])
    assert out.count() == 2001 and out.where("k = 'hot'").first()["v"] == 0


def test_tables_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("﻿a,b\n1,x\n2,y\n", encoding="utf-8")
    df = tables.read_table(spark, str(path))
    assert df.columns == ["a", "b"]
    for fmt in ("parquet", "csv"):
        tables.write_tables({"t": df}, str(tmp_path / fmt), "run1", {"seed": 1}, format=fmt)
        tables.write_tables({"t": df.limit(1)}, str(tmp_path / fmt), "run2", format=fmt)
        back = tables.read_result(spark, str(tmp_path / fmt), "t", "run1", fmt)
        assert sorted(map(tuple, back.collect())) == [("1", "x"), ("2", "y")]
    one = tables.content_fingerprint(df).first()
    assert one == tables.content_fingerprint(df.orderBy(F.desc("a")).repartition(3)).first()
    assert one != tables.content_fingerprint(df.withColumn("b", F.lit("x"))).first()
    assert all(math.isfinite(float(one[f"digest_{i}"])) for i in (1, 2, 3, 4))


def test_qc_reads_text_and_not_a_number(spark):
    rows = [("a", "0.2", "100"), ("b", "n.d.", "100"), ("c", "NaN", "100"), ("d", "0.9", "about"), ("e", " 0.5 ", "300")]
    df = frame(spark, [base()]).drop("PDI", "particle_size").crossJoin(spark.createDataFrame(rows, "row string, PDI string, particle_size string"))
    reasons = {r["row"]: r["removal_reason"] for r in quality.qc_filter(df)[1].collect()}
    assert reasons == {"b": "PDI_missing", "c": "PDI_missing", "d": "PDI>0.5;size_missing"}
    assert {r["row"] for r in quality.qc_filter(df, require_complete=False)[1].collect()} == {"d"}


def test_a_repeated_run_replaces_itself(spark, tmp_path):
    df = spark.range(3)
    for fmt in ("parquet", "csv"):
        for _ in range(2):
            tables.write_tables({"t": df}, str(tmp_path / fmt), "run/1 a", format=fmt)
        tables.write_tables({"t": df.limit(1)}, str(tmp_path / fmt), "run2", format=fmt)
        assert tables.read_result(spark, str(tmp_path / fmt), "t", "run/1 a", fmt).count() == 3
    tables.write_tables({"t": df.limit(0)}, str(tmp_path / "parquet"), "run2")
    assert tables.read_result(spark, str(tmp_path / "parquet"), "t", "run2").count() == 0


def test_fingerprint_tells_rows_apart(spark):
    def of(*rows):
        return tables.content_fingerprint(spark.createDataFrame(list(rows), "a string, b string")).first()

    assert of(("a|b", "c")) != of(("a", "b|c"))
    assert of((None, "x")) != of(("N", "x")) != of(("<null>", "x"))
    assert of(("", None)) != of((None, ""))


def test_compressed_text_is_read_by_its_inner_extension(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "x.csv.gz", "wt") as out:
        out.write("a,PDI\n1,n.d.\n2,0.3\n")
    assert tables.read_table(spark, str(tmp_path / "x.csv.gz")).columns == ["a", "PDI"]


def test_shared_vectors_work_out_the_share_once(spark):
    """The share of a row is a column beside the vector, not part of what is done to every element."""
    from trialmesh.operators import features

    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [5.0, 7.0])], "component string, vector array<double>")
    rows = spark.createDataFrame([("x", "a", 3.0, "b", 1.0), ("y", "b", 0.0, "c", 0.0), ("z", "c", 2.0, None, None)], "id string, IL1 string, IL1_molpct double, IL2 string, IL2_molpct double")
    out = features.shared_vector_features(rows, vectors, 3)
    assert {r["id"]: r["vector"] for r in out.collect()} == {"x": [2.0, 3.25, 0.0], "y": [5.0, 7.0, 0.0], "z": [0.0, 0.0, 0.0]}
    assert "AS _share#" in out._jdf.queryExecution().optimizedPlan().toString()
