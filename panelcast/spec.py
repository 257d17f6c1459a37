"""What a panel looks like and which settings a run uses: data only, no Spark."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

STEP_SECONDS = {"hour": 3600, "day": 86400, "week": 7 * 86400}


@dataclass(frozen=True)
class PanelSpec:
    """Column roles of a panel: one row per (entity, time).

    ``step`` is the finest spacing of ``time`` within an entity. Together with the unique
    (entity, time) key it bounds how many rows one time slot of an entity can hold.
    """

    entity: str
    time: str
    target: str
    signals: tuple[str, ...]
    keys: tuple[str, ...] = ()
    week: str | None = None
    step: str = "week"

    @property
    def join_keys(self) -> list[str]:
        return list(self.keys) or [self.entity, self.time]


@dataclass(frozen=True)
class MlpConfig:
    """Network and solver settings of one model family; the defaults are fixed values of the published run.

    One fit runs in one task and holds at most the rows that its steps draw: epochs x steps x batch.
    """

    hidden: tuple[int, ...] = (100, 25)
    dropout: tuple[float, ...] = (0.3, 0.7)
    learning_rate: float = 0.01
    epochs: int = 40
    steps: int = 200
    batch: int = 16
    patience: int = 3
    reshuffle: bool = True


@dataclass(frozen=True)
class EntityPlan:
    """How one entity is modelled: representation, network, and conversion to counts."""

    representation: str
    config: str
    rounding: str
    seed: int = 42
    lags: dict[str, int] = field(default_factory=dict)

    def width(self, spec: PanelSpec) -> int:
        """Inputs of the network."""
        per_signal = 1 + len(MEAN_WINDOWS) + len(STD_WINDOWS) + 2
        summaries, raw = per_signal * len(spec.signals) + 4, sum(self.lags.values())
        return {"multiscale": summaries, "raw_lags": raw, "both": raw + summaries}[self.representation]


# History windows in rows, context length, split length.
MEAN_WINDOWS = (2, 4, 8, 13, 26, 52)
STD_WINDOWS = (4, 13)
GAP_WINDOWS = (4, 13)
TREND_ROWS = 12
HISTORY_ROWS = 52
LEAD_ROWS = 53
HORIZON_ROWS = 52
WEEKS_PER_YEAR = 52.0

# Sparse lags and shifted-mean windows of the tree features.
TREE_LAGS = (1, 2, 4, 8, 12, 16)
TREE_MEANS = (2, 4, 8, 12, 16)

# Column names of the weekly climate panel.
CLIMATE_SIGNALS = (
    "precipitation_amt_mm",
    "reanalysis_air_temp_k",
    "reanalysis_avg_temp_k",
    "reanalysis_dew_point_temp_k",
    "reanalysis_max_air_temp_k",
    "reanalysis_min_air_temp_k",
    "reanalysis_precip_amt_kg_per_m2",
    "reanalysis_relative_humidity_percent",
    "reanalysis_sat_precip_amt_mm",
    "reanalysis_specific_humidity_g_per_kg",
    "reanalysis_tdtr_k",
    "station_avg_temp_c",
    "station_diur_temp_rng_c",
    "station_max_temp_c",
    "station_min_temp_c",
    "station_precip_mm",
)
VEGETATION_SIGNALS = ("ndvi_ne", "ndvi_nw", "ndvi_se", "ndvi_sw")

# Contiguous history length per signal and series, in vector order.
RAW_LAG_ROWS = {
    "precipitation_amt_mm": {"sj": 40, "iq": 33},
    "reanalysis_air_temp_k": {"sj": 16, "iq": 10},
    "reanalysis_avg_temp_k": {"sj": 15, "iq": 4},
    "reanalysis_dew_point_temp_k": {"sj": 39, "iq": 6},
    "reanalysis_max_air_temp_k": {"sj": 12, "iq": 41},
    "reanalysis_min_air_temp_k": {"sj": 21, "iq": 40},
    "reanalysis_precip_amt_kg_per_m2": {"sj": 30, "iq": 3},
    "reanalysis_relative_humidity_percent": {"sj": 34, "iq": 7},
    "reanalysis_sat_precip_amt_mm": {"sj": 40, "iq": 33},
    "reanalysis_specific_humidity_g_per_kg": {"sj": 14, "iq": 26},
    "reanalysis_tdtr_k": {"sj": 21, "iq": 34},
    "station_avg_temp_c": {"sj": 41, "iq": 40},
    "station_diur_temp_rng_c": {"sj": 40, "iq": 26},
    "station_max_temp_c": {"sj": 37, "iq": 39},
    "station_min_temp_c": {"sj": 26, "iq": 25},
    "station_precip_mm": {"sj": 32, "iq": 10},
    "weekofyear": {"sj": 3, "iq": 3},
}

CLIMATE_PANEL = PanelSpec(
    entity="city",
    time="week_start_date",
    target="total_cases",
    signals=CLIMATE_SIGNALS,
    keys=("city", "year", "weekofyear"),
    week="weekofyear",
    step="day",
)


def raw_lag_table(series: str) -> dict[str, int]:
    """Signal -> history length of one published series, in vector order."""
    return {signal: rows[series] for signal, rows in RAW_LAG_ROWS.items()}


@dataclass(frozen=True)
class RunSettings:
    """Everything a forecast run needs besides its input tables.

    By default nothing wraps or crosses series: no circular history, fill and scaling per entity. An
    offset of k rows makes a prediction rest on history ending k rows before its row; ``train_offset``
    and ``test_offset`` set it for either split. ``entities`` lists series with a plan of their own, all
    others follow ``default``, or are left out without one. ``historical_settings`` are the published
    choices.
    """

    configs: dict[str, MlpConfig]
    entities: dict[object, EntityPlan] = field(default_factory=dict)
    default: EntityPlan | None = None
    fill_scope: str = "entity"
    fill_method: str = "linear"
    scale_entity: str | None = None
    scale_tail: int = 0
    lead_in: str = "none"
    train_offset: int = 0
    test_offset: int = 0

    @property
    def lead_rows(self) -> int:
        """Context rows in front of a split: enough for a full history before its first example."""
        return max(LEAD_ROWS, HISTORY_ROWS - 1 + self.test_offset)


def historical_settings() -> RunSettings:
    """The published two-city run: shared scaling, frame-wide fill, circular lead-in, two-row offset.

    Network shapes, rates and patience are fixed values.
    """
    return RunSettings(
        configs={
            "sj": MlpConfig(),
            "iq": MlpConfig(
                hidden=(70, 18), dropout=(0.5, 0.5), learning_rate=0.001, patience=5, reshuffle=False
            ),
        },
        entities={
            "sj": EntityPlan("multiscale", "sj", "nearest"),
            "iq": EntityPlan("raw_lags", "iq", "truncate", lags=raw_lag_table("iq")),
        },
        fill_scope="frame",
        scale_entity="sj",
        scale_tail=LEAD_ROWS,
        lead_in="circular",
        test_offset=2,
    )


# Epochs and steps of the published hold-out run.
HOLDOUT_EPOCHS, HOLDOUT_STEPS = 28, 120


def holdout_settings() -> RunSettings:
    """The published hold-out evaluation: `historical_settings` trained for 28 epochs of 120 steps."""
    run = historical_settings()
    shorter = {name: replace(c, epochs=HOLDOUT_EPOCHS, steps=HOLDOUT_STEPS) for name, c in run.configs.items()}
    return replace(run, configs=shorter)
