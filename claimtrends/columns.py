"""Column names, header variants, schemas and the parameters shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted CSV headers per canonical column, first match wins, case-sensitive.
HEADER_VARIANTS: dict[str, tuple[str, ...]] = {
    "record_type": ("Utilization Type", "Record ID", "RecordID", "record_id"),
    "state": ("State", "State Code", "StateCode", "state_code"),
    "ndc11": ("NDC", "ndc", "National Drug Code"),
    "ndc_labeler": ("Labeler Code", "LabelerCode", "labeler_code"),
    "ndc_product": ("Product Code", "ProductCode", "product_code"),
    "ndc_package": ("Package Size", "PackageSize", "package_size"),
    "year": ("Year", "year"),
    "quarter": ("Quarter", "quarter", "Qtr"),
    "suppression_used": ("Suppression Used", "SuppressionUsed", "suppression_used"),
    "product_name_fda10": (
        "Product Name", "Product FDA List Name", "ProductFDAListName", "product_name",
    ),
    "units_reimbursed": ("Units Reimbursed", "UnitsReimbursed", "units_reimbursed"),
    "prescriptions": (
        "Number of Prescriptions", "No. of Prescriptions", "NoOfPrescriptions",
        "prescriptions", "Scripts",
    ),
    "total_amount": ("Total Amount Reimbursed", "TotalAmountReimbursed", "total_amount"),
    "medicaid_amount": (
        "Medicaid Amount Reimbursed", "MedicaidAmountReimbursed", "medicaid_amount",
    ),
    "non_medicaid_amount": (
        "Non Medicaid Amount Reimbursed", "Non-Medicaid Amount Reimbursed",
        "NonMedicaidAmountReimbursed", "non_medicaid_amount",
    ),
}

# How each canonical column is derived from its raw text.
COLUMN_KINDS: dict[str, str] = {
    **dict.fromkeys(HEADER_VARIANTS, "text"),
    "state": "code",
    "year": "int",
    "quarter": "int",
    "prescriptions": "bigint",
    "units_reimbursed": "double",
    "total_amount": "double",
    "medicaid_amount": "double",
    "non_medicaid_amount": "double",
}

CLAIM_MEASURES = (
    "units_reimbursed", "prescriptions", "total_amount", "medicaid_amount",
    "non_medicaid_amount",
)

AGGREGATE_KEYS = ("state", "ndc11_normalized", "product_name_fda10", "quarter_start")

FORECAST_SCHEMA = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("ndc11", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("forecast_period", T.IntegerType()),
    T.StructField("forecast_date", T.DateType()),
    T.StructField("forecast_quarter_start", T.DateType()),
    T.StructField("forecast_value", T.DoubleType()),
    T.StructField("forecast_lower", T.DoubleType()),
    T.StructField("forecast_upper", T.DoubleType()),
    T.StructField("error", T.StringType()),
])


@dataclass(frozen=True)
class SeriesSpec:
    """What makes a time series: its keys, its time column and a unique order within.

    ``tiebreak`` settles rows that share a time, so that lags do not depend on
    partitioning. ``measures`` maps the short name used in feature columns to the column.
    """

    keys: tuple[str, ...] = ("state", "ndc11_normalized")
    time: str = "quarter_start"
    tiebreak: tuple[str, ...] = ("product_name_fda10",)
    measures: tuple[tuple[str, str], ...] = (
        ("spend", "total_spend"),
        ("units", "total_units"),
        ("scripts", "total_scripts"),
    )

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.time, *self.tiebreak)

    def latest_first(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(
            F.col(self.time).desc(), *[F.col(c).asc() for c in self.tiebreak]
        )


DRUG_SERIES = SeriesSpec()

# The dashboard variant follows product names instead of drug codes.
PRODUCT_SERIES = SeriesSpec(
    keys=("state", "product_name_fda10"), tiebreak=("ndc11_normalized",)
)


@dataclass(frozen=True)
class RiskRules:
    """Thresholds and score weights of the risk rules (fixed values)."""

    high_cost_quantile: float = 0.75
    very_high_cost_quantile: float = 0.90
    cv_high: float = 1.0
    cv_extreme: float = 2.0
    change_high: float = 0.35
    change_high_without_cv: float = 0.50
    change_extreme: float = 0.75
    growth_fast: float = 0.25
    growth_extreme: float = 0.50
    score_levels: tuple[tuple[str, int], ...] = (("high", 100), ("medium", 50))
    score_weights: tuple[tuple[str, int], ...] = (
        ("high_cost", 20),
        ("high_vol", 15),
        ("fast_riser", 15),
        ("extreme_vol", 10),
        ("extreme_riser", 10),
        ("rapid_decline", 10),
    )
    score_cap: int = 100


@dataclass(frozen=True)
class DashboardRules:
    """Thresholds and weights of the dashboard's simpler score (fixed values)."""

    high_cost_quantile: float = 0.75
    cv_high: float = 1.0
    change_high: float = 0.35
    growth_fast: float = 0.25
    score_weights: tuple[tuple[str, int], ...] = (
        ("high_cost", 30), ("high_vol", 25), ("fast_riser", 25),
    )
    cv_weight: float = 20.0
