"""Named marketing constructs of a user or customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.config import CustomerConfig
from buyerlens.functions.frames import horizontal_sum
from buyerlens.operators.transforms import Scaler, fit_scaler
from buyerlens.operators.user_table import OTHER, SHARE, UNKNOWN

RFM = ("rfm_R", "rfm_F", "rfm_M")


def family_name(column: str) -> str:
    """``MntMeatProducts`` to ``meat``."""
    for part in ("Mnt", "Products", "Prods"):
        column = column.replace(part, "")
    return column.lower()


def customer_constructs(df: DataFrame, cfg: CustomerConfig) -> tuple[DataFrame, list[str]]:
    """Recency, frequency, monetary value, deal reliance and spend shares."""
    freq, spend = horizontal_sum(cfg.frequency), horizontal_sum(cfg.spend)
    cols = {
        "rfm_R": F.col(cfg.recency).cast("double"),
        "rfm_F": freq,
        "rfm_M": spend,
        "price_sensitivity": F.col(cfg.deals) / F.greatest(freq, F.lit(1.0)),
    }
    for c in cfg.spend:
        cols[f"affinity_{family_name(c)}"] = F.col(c) / F.greatest(spend, F.lit(1.0))
    return df.withColumns(cols), list(cols)


def affinity_columns(columns: list[str]) -> list[str]:
    """Share columns of known categories."""
    tails = {f"{SHARE}{UNKNOWN}", f"{SHARE}{OTHER}"}
    return [c for c in columns if c.startswith(SHARE) and c not in tails]


def user_constructs(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Recency, frequency, monetary value, price tier and known category shares."""
    cols = {
        "rfm_R": F.col("recency_days").cast("double"),
        "rfm_F": F.col("n_purch").cast("double"),
        "rfm_M": F.col("total_purch_value").cast("double"),
        "price_sensitivity": -F.col("mean_view_price"),
    }
    for c in affinity_columns(df.columns):
        cols[c.replace(SHARE, "affinity_")] = F.col(c)
    return df.withColumns(cols), list(cols)


def standardised(df: DataFrame, names: list[str]) -> tuple[DataFrame, Scaler]:
    """Add ``c_<name>`` scaled by training moments next to each raw construct."""
    scaler = fit_scaler(df, names)
    return df.withColumns({f"c_{n}": scaler.column(n) for n in names}), scaler
