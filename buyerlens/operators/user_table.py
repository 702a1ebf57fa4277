"""Event log to one row per user: strictly earlier features, strictly later labels."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerlens.config import EventConfig
from buyerlens.functions.frames import horizontal_sum
from buyerlens.plans.lookups import salted_lookup

SHARE = "cat_share_"
COUNT = "cnt_"
UNKNOWN = "unknown"
OTHER = "other"
DAYS_PER_WORD = 62
BASE_COLUMNS = (
    "recency_days",
    "n_events",
    "n_views",
    "n_carts",
    "n_purch",
    "n_sessions",
    "n_active_days",
    "total_purch_value",
    "mean_purch_value",
    "max_purch_value",
    "mean_view_price",
    "cart_abandon_rate",
    "conversion",
)
LABEL_COLUMNS = ("label_purchase", "label_any_event", "label_churned", "label_next_cat")


def anchor(moment: datetime) -> Column:
    """A naive datetime as a TIMESTAMP_NTZ literal."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def epoch_second(ts: str) -> Column:
    """Whole seconds since 1970 of a wall time, free of the session time zone."""
    days = F.datediff(F.to_date(ts), F.lit(date(1970, 1, 1))).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def after_label(cfg: EventConfig) -> datetime:
    """First instant past the closed label window at whole-second resolution."""
    return cfg.label_end + timedelta(seconds=1)


def window_flags(cfg: EventConfig) -> dict[str, Column]:
    """Window membership and event kind of a log row."""
    ts, kind = F.col("ts"), F.col("event_type")
    return {
        "in_feat": (ts >= anchor(cfg.feature_start)) & (ts < anchor(cfg.label_start)),
        "in_label": (ts >= anchor(cfg.label_start)) & (ts < anchor(after_label(cfg))),
        "is_view": kind == "view",
        "is_cart": kind == "cart",
        "is_purch": kind == "purchase",
    }


def between(log: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Rows with ``start <= ts < end``; a day-partitioned log also skips whole folders."""
    kept = log.where((F.col("ts") >= anchor(start)) & (F.col("ts") < anchor(end)))
    if "event_date" in log.columns:
        last = (end - timedelta(microseconds=1)).date()
        kept = kept.where(F.col("event_date").between(F.lit(start.date()), F.lit(last)))
    return kept


def feature_events(log: DataFrame, cfg: EventConfig) -> DataFrame:
    """Feature-window rows that carry a category."""
    return between(log, cfg.feature_start, cfg.label_start).where(F.col("top_cat").isNotNull())


def category_vocabulary(log: DataFrame, cfg: EventConfig) -> DataFrame:
    """The most frequent top-level categories of the feature window: ``(rank, top_cat, n)``."""
    top = (
        feature_events(log, cfg)
        .groupBy("top_cat")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "top_cat")
        .limit(cfg.top_categories)
    )
    best = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "top_cat")))
    return top.agg(best.alias("v")).select(F.posexplode("v").alias("pos", "e")).select(
        (F.col("pos") + 1).cast("bigint").alias("rank"),
        F.col("e.top_cat").alias("top_cat"),
        (-F.col("e.m")).alias("n"),
    )


def vocabulary_names(log: DataFrame, cfg: EventConfig) -> list[str]:
    """The vocabulary in rank order; at most ``top_categories`` names."""
    rows = category_vocabulary(log, cfg).collect()
    return [r["top_cat"] for r in sorted(rows, key=lambda r: r["rank"])]


def category_lookup(log: DataFrame) -> DataFrame:
    """Category id to top-level name, from every row that has both.

    Pairs are counted first: counts are hashed, while a minimum of strings sorts its input.
    """
    pairs = (
        log.where(F.col("top_cat").isNotNull())
        .groupBy("category_id", "top_cat")
        .agg(F.count("*").alias("n"))
        .where("n > 0")
    )
    return pairs.groupBy("category_id").agg(F.min("top_cat").alias("top_cat_lookup"))


def has_other(vocab: list[str], cfg: EventConfig) -> bool:
    """Whether the vocabulary hit its cap, so that some categories fall outside it."""
    return len(vocab) >= cfg.top_categories


def share_columns(vocab: list[str], cfg: EventConfig) -> list[str]:
    """Names of the category-share features."""
    tail = [UNKNOWN, OTHER] if has_other(vocab, cfg) else [UNKNOWN]
    return [f"{SHARE}{c}" for c in [*vocab, *tail]]


def _day_words(cfg: EventConfig) -> int:
    days = (cfg.label_start.date() - cfg.feature_start.date()).days + 1
    return -(-days // DAYS_PER_WORD)


def window_rows(log: DataFrame, cfg: EventConfig) -> DataFrame:
    """The rows of both windows with their flags, and only the columns that the user table sums.

    Events without a user belong to nobody's row and are left out.
    """
    flags = window_flags(cfg)
    return between(log, cfg.feature_start, after_label(cfg)).where(F.col("user_id").isNotNull()).select(
        "user_id", "user_session", "ts", "price", "top_cat",
        *[c.alias(n) for n, c in flags.items()],
    )


def user_sums(rows: DataFrame, cfg: EventConfig, vocab: list[str]) -> DataFrame:
    """Sums per user, added up in every task before the one wide shuffle.

    Distinct days are a bit mask over the days of the window. Every buffer is a number or a flag,
    so the sums are hashed, never sorted.
    """
    feat = F.col("in_feat")
    view, cart, purch = (feat & F.col(f"is_{k}") for k in ("view", "cart", "purch"))
    bought = F.col("in_label") & F.col("is_purch")
    day = F.datediff(F.to_date("ts"), F.lit(cfg.feature_start.date()))
    masks = [
        F.bit_or(
            F.when(
                feat & (day >= w * DAYS_PER_WORD) & (day < (w + 1) * DAYS_PER_WORD),
                F.call_function("shiftleft", F.lit(1).cast("bigint"), day - w * DAYS_PER_WORD),
            )
        ).alias(f"days_{w}")
        for w in range(_day_words(cfg))
    ]
    return rows.groupBy("user_id").agg(
        F.count_if(feat).alias("n_events"),
        F.count_if(view).alias("n_views"),
        F.count_if(cart).alias("n_carts"),
        F.count_if(purch).alias("n_purch"),
        *masks,
        F.max(F.when(feat, epoch_second("ts"))).alias("last_second"),
        F.sum(F.when(purch, F.col("price"))).alias("purch_sum"),
        F.count(F.when(purch, F.col("price"))).alias("purch_n"),
        F.max(F.when(purch, F.col("price"))).alias("purch_max"),
        F.sum(F.when(view, F.col("price"))).alias("view_sum"),
        F.count(F.when(view, F.col("price"))).alias("view_n"),
        F.bool_or(F.coalesce(bought, F.lit(False))).alias("label_purchase"),
        F.bool_or(F.coalesce(F.col("in_label"), F.lit(False))).alias("label_any_event"),
        *[F.count_if(feat & (F.col("top_cat") == c)).alias(f"{COUNT}{c}") for c in vocab],
        F.count_if(feat & F.col("top_cat").isNull()).alias(f"{COUNT}{UNKNOWN}"),
    )


def session_counts(rows: DataFrame) -> DataFrame:
    """``(user_id, n_sessions)``: distinct feature-window sessions, a null one counting as one.

    Two narrow columns are shuffled, so a user with very many events is spread over its sessions.
    """
    sessions = rows.where("in_feat").select("user_id", "user_session").distinct()
    return sessions.groupBy("user_id").agg(F.count("*").alias("n_sessions"))


def user_aggregates(log: DataFrame, cfg: EventConfig, vocab: list[str]) -> DataFrame:
    """Counts, sums and label parts per user, kept where the universe threshold is met.

    Sums and session counts meet on the user, by which both are partitioned already.
    """
    rows = window_rows(log, cfg)
    masks = [f"days_{w}" for w in range(_day_words(cfg))]
    days = sum((F.coalesce(F.bit_count(m), F.lit(0)) for m in masks), F.lit(0))
    return (
        user_sums(rows, cfg, vocab)
        .where(F.col("n_events") >= cfg.min_events)
        .join(session_counts(rows), "user_id", "left")
        .withColumn("n_sessions", F.coalesce("n_sessions", F.lit(0)).cast("bigint"))
        .withColumn("n_active_days", days.cast("bigint"))
        .drop(*masks)
    )


def derived_columns(cfg: EventConfig, vocab: list[str]) -> dict[str, Column]:
    """Recency, filled price aggregates, guarded ratios and shares of a user row."""
    zero = F.lit(0.0)
    events = F.col("n_events").cast("double")
    purch, views, carts = (F.col(c).cast("double") for c in ("n_purch", "n_views", "n_carts"))
    label_start = int((cfg.label_start - datetime(1970, 1, 1)).total_seconds())
    cols = {
        "recency_days": (F.lit(label_start) - F.col("last_second")) / F.lit(86400.0),
        "total_purch_value": F.coalesce(F.col("purch_sum"), zero),
        "mean_purch_value": F.coalesce(F.try_divide("purch_sum", "purch_n"), zero),
        "max_purch_value": F.coalesce(F.col("purch_max"), zero),
        "mean_view_price": F.coalesce(F.try_divide("view_sum", "view_n"), zero),
        "cart_abandon_rate": F.when(carts > 0, 1.0 - F.try_divide(purch, carts)).otherwise(zero),
        "conversion": F.when(views > 0, F.try_divide(purch, views)).otherwise(zero),
    }
    known = [*vocab, UNKNOWN]
    for c in known:
        cols[f"{SHARE}{c}"] = F.try_divide(F.col(f"{COUNT}{c}").cast("double"), events)
    if has_other(vocab, cfg):
        rest = events - horizontal_sum([f"{COUNT}{c}" for c in known])
        cols[f"{SHARE}{OTHER}"] = F.try_divide(rest, events)
    return cols


def next_purchases(log: DataFrame, cfg: EventConfig) -> DataFrame:
    """``(user_id, category_id)`` of the first label-window purchase that has a category.

    Order is time in whole seconds, then product. Only label-window purchases are read here, so
    the ordered minimum, which Spark sorts for, sees a small part of the log.
    """
    flags = window_flags(cfg)
    bought = between(log, cfg.label_start, after_label(cfg)).where(
        flags["is_purch"] & F.col("category_id").isNotNull()
    )
    first = F.struct(epoch_second("ts").alias("second"), F.col("product_id"), F.col("category_id"))
    return (
        bought.groupBy("user_id")
        .agg(F.min(first).alias("first"))
        .select("user_id", F.col("first.category_id").alias("category_id"))
    )


def with_next_category(users: DataFrame, log: DataFrame, cfg: EventConfig) -> DataFrame:
    """Decode the first label-window purchase; undecodable ones read ``unknown``.

    Only purchasers meet the lookup; the result joins the users on the key both are already
    partitioned by.
    """
    named = salted_lookup(next_purchases(log, cfg), category_lookup(log), "category_id", "user_id")
    decoded = users.join(named.select("user_id", "top_cat_lookup"), "user_id", "left")
    return decoded.withColumn(
        "label_next_cat",
        F.when(F.col("label_purchase"), F.coalesce("top_cat_lookup", F.lit(UNKNOWN))),
    )


def build_user_table(log: DataFrame, cfg: EventConfig, vocab: list[str] | None = None) -> DataFrame:
    """One row per user of the universe: features, shares and labels."""
    vocab = vocabulary_names(log, cfg) if vocab is None else vocab
    users = user_aggregates(log, cfg, vocab).withColumns(derived_columns(cfg, vocab))
    users = with_next_category(users, log, cfg).withColumn("label_churned", ~F.col("label_any_event"))
    return users.select("user_id", *BASE_COLUMNS, *share_columns(vocab, cfg), *LABEL_COLUMNS)


def feature_columns(table: DataFrame, id_column: str = "user_id") -> list[str]:
    """Feature names: everything but the id and what is named ``label_*``."""
    return [c for c in table.columns if c != id_column and not c.startswith("label_")]


def next_category_classes(features: list[str]) -> list[str]:
    """Class space of the next-category task, drawn from the feature vocabulary only."""
    tails = {f"{SHARE}{UNKNOWN}", f"{SHARE}{OTHER}"}
    known = sorted(c.removeprefix(SHARE) for c in features if c.startswith(SHARE) and c not in tails)
    return [*known, OTHER, UNKNOWN]


def class_code(label: str | Column, classes: list[str]) -> Column:
    """Index in the class space; names outside it count as ``other``; null stays null."""
    label = F.col(label) if isinstance(label, str) else label
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), label)
    code = F.when(place > 0, place - 1).otherwise(F.lit(classes.index(OTHER)))
    return F.when(label.isNotNull(), code).cast("bigint")


def threshold_table(log: DataFrame, cfg: EventConfig, thresholds: list[int]) -> DataFrame:
    """Universe size and purchase rate for several minimum event counts."""
    flags = window_flags(cfg)
    per_user = (
        between(log, cfg.feature_start, after_label(cfg))
        .groupBy("user_id")
        .agg(
            F.count_if(flags["in_feat"]).alias("n_events"),
            F.bool_or(F.coalesce(flags["in_label"] & flags["is_purch"], F.lit(False))).alias("bought"),
        )
    )
    wanted = F.array(*[F.lit(t).cast("bigint") for t in thresholds])
    return (
        per_user.withColumn("threshold", F.explode(wanted))
        .where(F.col("n_events") >= F.col("threshold"))
        .groupBy("threshold")
        .agg(
            F.count("*").alias("users"),
            F.avg(F.col("bought").cast("double")).alias("positive_rate"),
        )
    )
