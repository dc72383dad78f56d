import datetime as dt

import pytest

from claimtrends.columns import HEADER_VARIANTS
from claimtrends.operators import canonical

HEADERS = [
    "State Code", "NDC", "Year", "Qtr", "Product Name", "Units Reimbursed",
    "No. of Prescriptions", "Total Amount Reimbursed", "Medicaid Amount Reimbursed",
    "Non-Medicaid Amount Reimbursed",
]


def claim(**values):
    row = {
        "State Code": "CA", "NDC": "00002143380", "Year": "2024", "Qtr": "1",
        "Product Name": "Drug", "Units Reimbursed": "10", "No. of Prescriptions": "2",
        "Total Amount Reimbursed": "100", "Medicaid Amount Reimbursed": "60",
        "Non-Medicaid Amount Reimbursed": "40",
    }
    return {**row, **values}


@pytest.fixture
def build(spark):
    schema = ", ".join(f"`{h}` string" for h in HEADERS)

    def make(*rows):
        raw = spark.createDataFrame([tuple(r[h] for h in HEADERS) for r in rows], schema)
        return canonical.apply_schema(raw, canonical.detect_columns(raw.columns))

    return make


def test_first_variant_wins_and_case_matters():
    found = canonical.detect_columns(["State Code", "State", "NDC", "ndc", "YEAR"])
    assert found == {"state": "State", "ndc11": "NDC"}


def test_all_variants_are_detected():
    for name, variants in HEADER_VARIANTS.items():
        for variant in variants:
            assert canonical.detect_columns([variant]) == {name: variant}


def test_absent_columns_stay_absent(spark):
    raw = spark.createDataFrame([("ca", "2024")], "State string, Year string")
    out = canonical.apply_schema(raw, canonical.detect_columns(raw.columns))
    assert out.columns == ["state", "year"]


def test_trim_case_and_header_with_a_dot(build):
    row = build(claim(**{"State Code": " ca ", "No. of Prescriptions": "12.0"})).first()
    assert (row.state, row.prescriptions) == ("CA", 12)


@pytest.mark.parametrize(
    ("year", "quarter", "expected"),
    [
        ("2024", "1", dt.date(2024, 1, 1)), ("2024", "4", dt.date(2024, 10, 1)),
        ("2024", "0", None), ("2024", "5", None), ("2024", None, None),
        ("n/a", "1", None), (None, "1", None), ("999999", "1", None),
    ],
)
def test_quarter_start(build, year, quarter, expected):
    assert build(claim(Year=year, Qtr=quarter)).first().quarter_start == expected


@pytest.mark.parametrize(
    ("code", "normal", "invalid", "invalid_strict"),
    [
        ("0002-1433-80", "00002143380", False, False),
        ("", "00000000000", False, True),
        ("abc", "00000000000", False, True),
        ("1234567890123", "12345678901", False, True),
        (None, None, True, True),
    ],
)
def test_ndc(build, code, normal, invalid, invalid_strict):
    rows = build(claim(NDC=code))
    assert rows.first().ndc11_normalized == normal
    assert canonical.validate_ranges(rows).first().invalid_ndc is invalid
    assert canonical.validate_ranges(rows, strict=True).first().invalid_ndc is invalid_strict


@pytest.mark.parametrize(
    ("state", "invalid", "invalid_strict"),
    [("CA", False, False), ("CAL", True, True), ("C1", False, True), (None, False, False)],
)
def test_state(build, state, invalid, invalid_strict):
    rows = build(claim(**{"State Code": state}))
    assert canonical.validate_ranges(rows).first().invalid_state is invalid
    assert canonical.validate_ranges(rows, strict=True).first().invalid_state is invalid_strict


@pytest.mark.parametrize(
    ("quarter", "invalid"), [("0", True), ("5", True), ("1", False), (None, False)]
)
def test_invalid_quarter(build, quarter, invalid):
    assert canonical.validate_ranges(build(claim(Qtr=quarter))).first().invalid_quarter is invalid


@pytest.mark.parametrize(
    ("medicaid", "mismatch"), [("60.005", False), ("60.02", True), (None, False), ("x", False)]
)
def test_spend_mismatch(build, medicaid, mismatch):
    rows = build(claim(**{"Medicaid Amount Reimbursed": medicaid}))
    assert rows.first().spend_mismatch is mismatch


def test_mismatch_is_judged_before_negatives_become_null(build):
    rows = build(claim(**{"Total Amount Reimbursed": "-5"}))
    row = canonical.validate_ranges(rows).first()
    assert row.spend_mismatch is True and row.total_amount is None


def test_cleanse_drops_flagged_and_incomplete_rows(build):
    rows = build(
        claim(), claim(Qtr="5"), claim(**{"State Code": "CAL"}), claim(NDC=None),
        claim(Year="x"), claim(**{"State Code": None}), claim(Qtr=None),
    )
    assert canonical.cleanse(canonical.validate_ranges(rows)).count() == 1
    counts = canonical.cleansing_counts(canonical.validate_ranges(rows)).collect()
    assert {(r.stage, r.row_count) for r in counts} == {("raw", 7), ("cleansed", 1)}
    # Without flags only the required columns count: the bad quarter has no start.
    assert canonical.cleanse(rows).count() == 2


def test_nonnegative_measures_acts_on_totals_only(spark, build):
    rows = build(claim(**{"Total Amount Reimbursed": "-5"}))
    assert canonical.nonnegative_measures(rows).count() == 1
    totals = spark.createDataFrame([(1.0,), (-1.0,), (None,), (0.0,)], "total_spend double")
    assert canonical.nonnegative_measures(totals).count() == 2


def test_time_dimensions(spark):
    rows = spark.createDataFrame([(dt.date(2024, 7, 1),)], "quarter_start date")
    row = canonical.time_dimensions(rows).first()
    assert (row.year, row.quarter) == (2024, 3)
