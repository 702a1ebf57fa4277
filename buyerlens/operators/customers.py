"""Row-wise engineering of the customer table; nothing here looks across rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerlens.config import CustomerConfig


def engineer(customers: DataFrame, cfg: CustomerConfig) -> DataFrame:
    """Age, tenure, collapsed junk levels, and the columns with a role."""
    joined = F.to_date("Dt_Customer", cfg.date_format)
    status = F.col("Marital_Status")
    return customers.withColumns(
        {
            "Age": (F.lit(cfg.reference_year) - F.col("Year_Birth")).cast("bigint"),
            "Customer_Tenure_Days": F.datediff(
                F.to_date(F.lit(cfg.tenure_reference)), joined
            ).cast("bigint"),
            "Marital_Status": F.when(
                status.isin(*cfg.junk_levels), F.lit(cfg.other_level)
            ).otherwise(status),
        }
    ).select(cfg.id_column, cfg.label, *cfg.numeric, *cfg.categorical)
