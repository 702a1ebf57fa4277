"""Frozen settings for every stage of the pipeline."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime


@dataclass(frozen=True)
class EventConfig:
    """Windows, universe and vocabulary settings of the event-log shape."""

    feature_start: datetime = datetime(2019, 10, 1)
    label_start: datetime = datetime(2019, 11, 22)
    label_end: datetime = datetime(2019, 11, 30, 23, 59, 59)
    min_events: int = 5
    top_categories: int = 15


def parse_anchor(text: str) -> datetime:
    """UTC wall time of an ISO anchor such as ``2019-10-01T00:00:00Z``."""
    return datetime.fromisoformat(text.removesuffix("Z"))


# Column names of the customer table.
SPEND_COLUMNS = (
    "MntWines",
    "MntFruits",
    "MntMeatProducts",
    "MntFishProducts",
    "MntSweetProducts",
    "MntGoldProds",
)
PURCHASE_COLUMNS = (
    "NumDealsPurchases",
    "NumWebPurchases",
    "NumCatalogPurchases",
    "NumStorePurchases",
)
CAMPAIGN_COLUMNS = (
    "AcceptedCmp1",
    "AcceptedCmp2",
    "AcceptedCmp3",
    "AcceptedCmp4",
    "AcceptedCmp5",
)
NUMERIC_COLUMNS = (
    "Income",
    "Age",
    "Kidhome",
    "Teenhome",
    "Recency",
    *SPEND_COLUMNS,
    *PURCHASE_COLUMNS,
    "NumWebVisitsMonth",
    "Complain",
    "Customer_Tenure_Days",
    *CAMPAIGN_COLUMNS,
)
CATEGORICAL_COLUMNS = ("Education", "Marital_Status")
WINSOR_COLUMNS = ("Income", "Age")


@dataclass(frozen=True)
class CustomerConfig:
    """Cleaning, role and split settings of the customer-table shape."""

    id_column: str = "ID"
    label: str = "Response"
    numeric: tuple[str, ...] = NUMERIC_COLUMNS
    categorical: tuple[str, ...] = CATEGORICAL_COLUMNS
    winsorised: tuple[str, ...] = WINSOR_COLUMNS
    recency: str = "Recency"
    frequency: tuple[str, ...] = PURCHASE_COLUMNS
    deals: str = "NumDealsPurchases"
    spend: tuple[str, ...] = SPEND_COLUMNS
    reference_year: int = 2014
    tenure_reference: str = "2015-01-01"
    date_format: str = "dd-MM-yyyy"
    junk_levels: tuple[str, ...] = ("Absurd", "YOLO", "Alone")
    other_level: str = "Other"
    winsor_low: float = 0.01
    winsor_high: float = 0.99
    test_size: float = 0.2
    val_size: float = 0.2


@dataclass(frozen=True)
class ModelConfig:
    """Network shape, loss weights and training length."""

    latent_dim: int = 16
    hidden_dims: tuple[int, ...] = (128, 64)
    lr: float = 1e-3
    epochs: int = 200
    batch_rows: int = 256
    shards: int | None = None  # parts of the rows that train side by side; by the number of rows if not given
    beta: float = 1.0
    lambda_align: float = 1.0
    aligned_dims: int | None = None
    min_free_dims: int = 4
    aligned_kl_weight: float = 1.0


@dataclass(frozen=True)
class EvalConfig:
    """Protocol settings shared by baselines, sweep and analysis."""

    seeds: tuple[int, ...] = (0, 1, 2, 3, 4, 5)
    n_clusters: int = 8
    n_init: int = 10
    train_subsample: int | None = None
    k_frac: float = 0.10
    top_ks: tuple[int, ...] = (1, 3, 5)
    methods: tuple[str, ...] | None = None
    gbt_iterations: int = 100
    stability_users: int | None = None  # all users unless a sample is asked for
    stability_seed: int = 4107
    n_boot: int = 20
    span: float = 2.0
    card_features: int = 8


@dataclass(frozen=True)
class SweepConfig:
    """Grid of the sweep."""

    betas: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0)
    lambdas: tuple[float, ...] = (0.0, 0.25, 1.0, 4.0)
    seeds: tuple[int, ...] = (0, 1, 2, 3, 4, 5)
