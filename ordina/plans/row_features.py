"""The row features of the subject table as a list of formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordina.config import ColumnRoles
from ordina.functions import features as ff

HOURS = "PreInt_EduHx-computerinternet_hoursday"
AGE = "Basic_Demos-Age"
BMI, HEIGHT, WEIGHT = "Physical-BMI", "Physical-Height", "Physical-Weight"
SYSTOLIC, DIASTOLIC = "Physical-Systolic_BP", "Physical-Diastolic_BP"
CGAS = "CGAS-CGAS_Score"
SLEEP = "SDS-SDS_Total_T"
PAQ = "PAQ_Total"
MISSING = "mine_feature_missing"


# --- fixed values: output name, formula family, inputs -----------------------
FGC = (
    "FGC-FGC_PU", "FGC-FGC_CU", "FGC-FGC_GSD", "FGC-FGC_GSND", "FGC-FGC_SRL", "FGC-FGC_SRR",
    "FGC-FGC_TL",
)
ZONES = (
    "FGC-FGC_CU_Zone", "FGC-FGC_PU_Zone", "FGC-FGC_SRL_Zone", "FGC-FGC_SRR_Zone",
    "FGC-FGC_TL_Zone",
)
ROW_FEATURES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("demo_Age_bmi", "product", (BMI, AGE)),
    ("demo_age_Internet_Hours", "product", (HOURS, AGE)),
    ("demo_age_Internet_Hours_2", "ratio", (HOURS, AGE)),
    ("cgas_bmi", "ratio", (BMI, CGAS)),
    ("cgas_height", "ratio", (HEIGHT, CGAS)),
    ("cgas_weight", "ratio", (WEIGHT, CGAS)),
    ("cgas_paq_total_1", "ratio", (PAQ, CGAS)),
    ("cgas_sds_total_1", "ratio", (SLEEP, CGAS)),
    ("cgas_intenet_1", "ratio_plus1", (CGAS, HOURS)),
    ("cgas_paq_total_2", "product", (PAQ, CGAS)),
    ("cgas_sds_total_2", "product", (SLEEP, CGAS)),
    ("cgas_intenet_2", "product", (CGAS, HOURS)),
    ("phisical_BMI_Internet_Hours", "ratio_plus1", (BMI, HOURS)),
    ("phisical_height_Internet_Hours", "ratio_plus1", (HEIGHT, HOURS)),
    ("phisical_weight_Internet_Hours", "ratio_plus1", (WEIGHT, HOURS)),
    ("phisical_Pulse_Pressure", "diff", (SYSTOLIC, DIASTOLIC)),
    ("phisical_Mean_Arterial_Pressure", "pressure", (DIASTOLIC, SYSTOLIC)),
    (
        "fitnessgram_Fitness_Endurance-Time_Total",
        "min_sec",
        ("Fitness_Endurance-Time_Mins", "Fitness_Endurance-Time_Sec"),
    ),
    (
        "fitnessgram_Fitness_Endurance_internet",
        "ratio_plus1",
        ("Fitness_Endurance-Max_Stage", HOURS),
    ),
    ("fitnessgramchild_SRTotal", "sum", ("FGC-FGC_SRR", "FGC-FGC_SRL")),
    (
        "fitnessgramchild_horizontal_mean_FGC",
        "row_mean",
        FGC,
    ),
    ("fitnessgramchild_Fitness_Level", "code_sum", ZONES),
    (
        "fitnessgramchild_Fitness_Achievements",
        "achievements",
        ("FGC-FGC_GSD_Zone", "FGC-FGC_GSD_Zone", *ZONES),
    ),
    ("fitnessgramchild_Overall_Flexibility_Score", "sum", ("FGC-FGC_SRR", "FGC-FGC_SRL", "FGC-FGC_TL")),
    ("bio_BFP_BMI", "ratio_plus1", ("BIA-BIA_Fat", "BIA-BIA_BMI")),
    ("bio_FFMI_BFP", "ratio_plus1", ("BIA-BIA_FFMI", "BIA-BIA_Fat")),
    ("bio_FMI_BFP", "ratio_plus1", ("BIA-BIA_FMI", "BIA-BIA_Fat")),
    ("bio_LST_TBW", "ratio_plus1", ("BIA-BIA_LST", "BIA-BIA_TBW")),
    ("bio_BFP_BMR", "product", ("BIA-BIA_Fat", "BIA-BIA_BMR")),
    ("bio_BFP_DEE", "product", ("BIA-BIA_Fat", "BIA-BIA_DEE")),
    ("bio_Muscle_to_Fat", "guarded_ratio", ("BIA-BIA_SMM", "BIA-BIA_FMI")),
    ("bio_ICW_TBW", "ratio_plus1", ("BIA-BIA_ICW", "BIA-BIA_TBW")),
    ("bio_Water_Balance_Ratio", "ratio_plus1", ("BIA-BIA_ECW", "BIA-BIA_ICW")),
    ("bio_BMR_Weight", "ratio_plus1", ("BIA-BIA_BMR", WEIGHT)),
    ("bio_DEE_Weight", "ratio_plus1", ("BIA-BIA_DEE", WEIGHT)),
    ("bio_SMM_Height", "ratio_plus1", ("BIA-BIA_SMM", HEIGHT)),
    ("bio_Hydration_Status", "ratio_plus1", ("BIA-BIA_TBW", WEIGHT)),
    ("sleep_activit_sleep_interaction_1", "ratio_plus1", (PAQ, SLEEP)),
    ("sleep_activit_sleep_interaction_2", "product", (PAQ, SLEEP)),
    ("internet_sds_1", "product", (HOURS, SLEEP)),
    ("internet_sds_2", "ratio", (HOURS, SLEEP)),
    ("internet_paq_1", "product", (HOURS, PAQ)),
    ("internet_paq_2", "ratio", (HOURS, PAQ)),
)
PAQ_SOURCES = ("PAQ_C-PAQ_C_Total", "PAQ_A-PAQ_A_Total")
# -----------------------------------------------------------------------------


def _formula(family: str, inputs: tuple[str, ...], zero: str) -> Column:
    if family == "product":
        return ff.feat_product(*inputs)
    if family == "ratio":
        return ff.feat_ratio(*inputs, zero=zero)
    if family == "ratio_plus1":
        return ff.feat_ratio_plus1(*inputs, zero=zero)
    if family == "guarded_ratio":
        return ff.feat_guarded_ratio(*inputs)
    if family == "pressure":
        return ff.feat_pressure(*inputs)
    if family == "diff":
        return ff.feat_diff(*inputs)
    if family == "min_sec":
        return ff.feat_min_sec(*inputs)
    if family == "sum":
        return ff.feat_sum(*inputs)
    if family == "row_mean":
        return ff.feat_row_mean(*inputs)
    if family == "code_sum":
        return ff.feat_sum(*inputs).cast("short")
    if family == "achievements":
        return ff.feat_threshold_sum(list(inputs[:2]), list(inputs[2:])).cast("short")
    raise ValueError(f"unknown formula family {family!r}")


def row_features(df: DataFrame, roles: ColumnRoles, zero: str = "null") -> DataFrame:
    """Add all row features; `zero` is the policy for zero divisors."""
    first = df.withColumns(
        {
            PAQ: ff.feat_coalesce(*PAQ_SOURCES),
            MISSING: ff.feat_null_count(*[F.col(c) for c in roles.inputs]),
        }
    )
    return first.withColumns(
        {name: _formula(family, inputs, zero) for name, family, inputs in ROW_FEATURES}
    )
