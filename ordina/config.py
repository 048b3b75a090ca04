"""Column roles and constants of the study tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- fixed values: column names and constants of the input files -------------
ID_COL = "id"
TARGET = "sii"
N_CLASSES = 4
N_FOLD = 5
BASE_THRESHOLDS = (0.5, 1.0, 1.5)
THRESHOLD_HALF_WIDTH = 0.2
THRESHOLD_POINTS = 25
ENSEMBLE_THRESHOLD_POINTS = 50
SAMPLES_PER_DAY = 17_280
ANCHOR_DAYS = 30

NUMERIC = (
    "Basic_Demos-Age", "CGAS-CGAS_Score",
    "Physical-BMI", "Physical-Height", "Physical-Weight", "Physical-Waist_Circumference",
    "Physical-Diastolic_BP", "Physical-HeartRate", "Physical-Systolic_BP",
    "Fitness_Endurance-Max_Stage", "Fitness_Endurance-Time_Mins", "Fitness_Endurance-Time_Sec",
    "FGC-FGC_CU", "FGC-FGC_GSND", "FGC-FGC_GSD", "FGC-FGC_PU",
    "FGC-FGC_SRL", "FGC-FGC_SRR", "FGC-FGC_TL",
    "BIA-BIA_BMC", "BIA-BIA_BMI", "BIA-BIA_BMR", "BIA-BIA_DEE", "BIA-BIA_ECW", "BIA-BIA_FFM",
    "BIA-BIA_FFMI", "BIA-BIA_FMI", "BIA-BIA_Fat", "BIA-BIA_ICW", "BIA-BIA_LDM", "BIA-BIA_LST",
    "BIA-BIA_SMM", "BIA-BIA_TBW",
    "PAQ_A-PAQ_A_Total", "PAQ_C-PAQ_C_Total", "SDS-SDS_Total_Raw", "SDS-SDS_Total_T",
)
SEASONS = (
    "Basic_Demos-Enroll_Season", "CGAS-Season", "Physical-Season", "Fitness_Endurance-Season",
    "FGC-Season", "BIA-Season", "PAQ_A-Season", "PAQ_C-Season", "SDS-Season",
    "PreInt_EduHx-Season",
)
CODES = (
    "Basic_Demos-Sex", "FGC-FGC_CU_Zone", "FGC-FGC_GSND_Zone", "FGC-FGC_GSD_Zone",
    "FGC-FGC_PU_Zone", "FGC-FGC_SRL_Zone", "FGC-FGC_SRR_Zone", "FGC-FGC_TL_Zone",
    "BIA-BIA_Activity_Level_num", "BIA-BIA_Frame_num", "PreInt_EduHx-computerinternet_hoursday",
)
TARGET_SEASON = "PCIAT-Season"
TARGET_ITEMS = (
    "PCIAT-PCIAT_01", "PCIAT-PCIAT_02", "PCIAT-PCIAT_03", "PCIAT-PCIAT_04",
    "PCIAT-PCIAT_05", "PCIAT-PCIAT_06", "PCIAT-PCIAT_07", "PCIAT-PCIAT_08",
    "PCIAT-PCIAT_09", "PCIAT-PCIAT_10", "PCIAT-PCIAT_11", "PCIAT-PCIAT_12",
    "PCIAT-PCIAT_13", "PCIAT-PCIAT_14", "PCIAT-PCIAT_15", "PCIAT-PCIAT_16",
    "PCIAT-PCIAT_17", "PCIAT-PCIAT_18", "PCIAT-PCIAT_19", "PCIAT-PCIAT_20",
    "PCIAT-PCIAT_Total",
)

SIGNALS = ("X", "Y", "Z", "enmo", "anglez", "light", "battery_voltage")
PLANAR_NORM = "2d_norm"
NON_WEAR = "non-wear_flag"
REL_DAY = "relative_date_PCIAT"
SERIES_PREFIX = "time_series_"
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnRoles:
    """Which column plays which part; the defaults describe the study files."""

    id_col: str = ID_COL
    target: str = TARGET
    numeric: tuple[str, ...] = NUMERIC
    seasons: tuple[str, ...] = SEASONS
    codes: tuple[str, ...] = CODES
    never_features: tuple[str, ...] = (TARGET_SEASON, *TARGET_ITEMS, "fold_info", "current_fold")
    signals: tuple[str, ...] = SIGNALS
    n_classes: int = N_CLASSES
    n_fold: int = N_FOLD
    label_maps: dict[str, dict[str, int]] = field(default_factory=dict)

    @property
    def inputs(self) -> tuple[str, ...]:
        """The columns whose nulls are counted per row."""
        return (*self.numeric, *self.seasons, *self.codes)

    @property
    def categorical(self) -> tuple[str, ...]:
        return (*self.seasons, *self.codes)

    def feature_columns(self, df) -> list[str]:
        """Every column of a gold table that may be fitted on."""
        excluded = {self.id_col, self.target, *self.never_features}
        return [c for c in df.columns if c not in excluded]


def subject_schema(roles: ColumnRoles = ColumnRoles(), with_target: bool = True) -> T.StructType:
    """Types of the subject table: seasons are text, codes are written `1` or `1.0`."""
    fields = [T.StructField(roles.id_col, T.StringType())]
    fields += [T.StructField(c, T.DoubleType()) for c in roles.numeric]
    fields += [T.StructField(c, T.StringType()) for c in roles.seasons]
    fields += [T.StructField(c, T.DoubleType()) for c in roles.codes]
    if with_target:
        fields.append(T.StructField(TARGET_SEASON, T.StringType()))
        fields += [T.StructField(c, T.DoubleType()) for c in TARGET_ITEMS]
        fields.append(T.StructField(roles.target, T.DoubleType()))
    return T.StructType(fields)


def series_schema(roles: ColumnRoles = ColumnRoles()) -> T.StructType:
    """Parquet schema of the sensor series; the id comes from the folder name."""
    fields = [T.StructField(c, T.DoubleType()) for c in roles.signals]
    fields += [
        T.StructField(NON_WEAR, T.DoubleType()),
        T.StructField(REL_DAY, T.DoubleType()),
        T.StructField("time_of_day", T.LongType()),
        T.StructField("weekday", T.ByteType()),
        T.StructField("quarter", T.ByteType()),
        T.StructField(roles.id_col, T.StringType()),
    ]
    return T.StructType(fields)
