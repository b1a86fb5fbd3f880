"""Header roles, cleaning, feature discovery, class index, and column-level summaries."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.tables import cut

# Header names accepted for each role, in order of preference.
ROLE_ALIASES = {
    "src_ip": ["IPV4_SRC_ADDR", "IPV6_SRC_ADDR", "SRC_IP", "SRCIP", "SOURCE_IP", "SA"],
    "dst_ip": ["IPV4_DST_ADDR", "IPV6_DST_ADDR", "DST_IP", "DSTIP", "DEST_IP", "DA"],
    "src_port": ["L4_SRC_PORT", "SRC_PORT", "SPORT", "SOURCE_PORT"],
    "dst_port": ["L4_DST_PORT", "DST_PORT", "DPORT", "DEST_PORT"],
    "protocol": ["PROTOCOL", "PROTO", "IP_PROTOCOL_VERSION"],
    "start_time": ["FLOW_START_MILLISECONDS", "FLOW_START_MS", "FLOW_START", "TIMESTAMP", "STIME", "FIRST_SWITCHED"],
    "end_time": ["FLOW_END_MILLISECONDS", "FLOW_END_MS", "FLOW_END", "LTIME", "LAST_SWITCHED"],
    "label": ["LABEL", "BINARY_LABEL", "IS_ATTACK"],
    "attack": ["ATTACK", "ATTACK_CAT", "ATTACK_CATEGORY", "CATEGORY", "CLASS"],
    "in_bytes": ["IN_BYTES", "SRC_TO_DST_BYTES"],
    "out_bytes": ["OUT_BYTES", "DST_TO_SRC_BYTES"],
    "in_pkts": ["IN_PKTS", "SRC_TO_DST_PKTS"],
    "out_pkts": ["OUT_PKTS", "DST_TO_SRC_PKTS"],
}
REQUIRED_ROLES = ["src_ip", "dst_ip", "start_time", "label"]
NON_FEATURE_ROLES = ["src_ip", "dst_ip", "src_port", "dst_port", "start_time", "end_time", "label", "attack"]
# Columns known to give the class away, and the pattern of heavy-tailed column names.
LEAKY_COLUMNS = ["MIN_TTL", "MAX_TTL", "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES"]
HEAVY_TAIL = r"(BYTES|PKTS|DURATION|THROUGHPUT|IAT|LEN|WIN_MAX|PKT)"


def plain_name(name: str) -> str:
    """Upper case with everything but letters and digits removed."""
    return "".join(ch for ch in name.upper() if ch.isascii() and ch.isalnum())


def resolve_columns(columns: Sequence[str]) -> dict[str, str]:
    """Role to physical column. Works on header names only, no data is read."""
    physical: dict[str, str] = {}
    for name in reversed(columns):
        physical[plain_name(name)] = name
    hits = {role: [physical[plain_name(a)] for a in aliases if plain_name(a) in physical] for role, aliases in ROLE_ALIASES.items()}
    return {role: names[0] for role, names in hits.items() if names}


def column_report(df: DataFrame) -> DataFrame:
    """One row per role: the column found, and whether a required one is missing."""
    found = resolve_columns(df.columns)
    rows = [(r, found.get(r, "NOT FOUND"), int(r in REQUIRED_ROLES and r not in found)) for r in ROLE_ALIASES]
    return df.sparkSession.createDataFrame(rows, "role string, column_name string, missing_required int")


def require_roles(columns: Sequence[str]) -> dict[str, str]:
    found = resolve_columns(columns)
    missing = [r for r in REQUIRED_ROLES if r not in found]
    if missing:
        raise ValueError(f"no column for the roles {missing}; available: {list(columns)}")
    return found


def time_unit(col: Column) -> Column:
    """Aggregate: the unit of a start-time column, read from where its median lies.

    Above 1e17 nanoseconds, above 1e14 microseconds, between 0 and 1e11 seconds, else milliseconds; "text"
    if at most 90 % of the cells are numbers. "More than half the values lie beyond x" decides where the
    median lies with constant memory.
    """
    x = S.number(col)
    most = lambda c: F.avg(c.cast("double")) > 0.5
    return (
        F.when(F.avg(x.isNotNull().cast("double")) <= 0.9, F.lit("text"))
        .when(most(x > 1e17), F.lit("ns"))
        .when(most(x > 1e14), F.lit("us"))
        .when(most(x > 0) & most(x < 1e11), F.lit("s"))
        .otherwise(F.lit("ms"))
    )


def in_epoch_ms(col: Column, unit: Column) -> Column:
    """A start-time cell in epoch milliseconds; NULL if it is no time.

    Text is read as a UTC timestamp, whatever the session's zone, unless it names a zone or an offset itself.
    """
    x, text = S.number(col), F.trim(col.cast("string"))
    timed = text.rlike(r"\d[T ]+\d")
    zoned = text.rlike(r"(?i)(Z|UTC|GMT|UT|[+-]\d{1,2}(:?\d{2}){0,2}|[a-z]+/[a-z_/]+)\s*$")
    instant = F.unix_micros(F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z")))))
    parsed = F.when(timed, instant / 1000.0).otherwise(F.unix_date(text.try_cast("date")) * 86_400_000.0)
    return F.when(unit == "text", parsed).when(unit == "ns", x / 1e6).when(unit == "us", x / 1e3).when(unit == "s", x * 1000.0).otherwise(x)


def epoch_ms(df: DataFrame, col: str, out: str = "start_ms") -> DataFrame:
    """Start time as epoch milliseconds, whatever the unit."""
    staged = df.withColumn("_unit", df.agg(time_unit(F.col(col)).alias("unit")).scalar())
    return staged.withColumn(out, in_epoch_ms(F.col(col), F.col("_unit"))).drop("_unit")


def numeric_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of cells that parse as numbers, per column, in one pass."""
    wide = df.agg(*[F.avg(S.number(F.col(c)).isNotNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column_name", "numeric_share")


def feature_candidates(columns: Sequence[str], exclude: Sequence[str] = (), leaky: Sequence[str] = tuple(LEAKY_COLUMNS)) -> list[str]:
    found = resolve_columns(columns)
    banned = {found[r] for r in NON_FEATURE_ROLES if r in found} | set(exclude) | set(leaky_columns(columns, leaky))
    return [c for c in columns if c not in banned]


def select_feature_columns(df: DataFrame, exclude: Sequence[str] = (), leaky: Sequence[str] = tuple(LEAKY_COLUMNS)) -> list[str]:
    """Columns that are neither identifiers, targets nor leaky and hold numbers in at least half their cells.

    Returns names, since they shape the schema; what reaches the driver is one number per column.
    """
    candidates = feature_candidates(df.columns, exclude, leaky)
    if not candidates:
        return []
    shares = df.agg(*[F.avg(S.number(F.col(c)).isNotNull().cast("double")).alias(c) for c in candidates]).first()
    return [c for c in candidates if (shares[c] or 0.0) >= 0.5]


def leaky_columns(columns: Sequence[str], names: Sequence[str] = tuple(LEAKY_COLUMNS)) -> list[str]:
    plain = {plain_name(n) for n in names}
    return [c for c in columns if plain_name(c) in plain]


def protocol_indicators(df: DataFrame, col: str) -> DataFrame:
    return df.withColumns({f"proto_is_{n}": S.protocol_flag(F.col(col), v) for n, v in S.PROTOCOLS.items()})


def label_is_text(df: DataFrame, col: str) -> Column:
    """Whether a label column holds words: true unless 90 % of its cells parse as numbers."""
    return df.agg((F.avg(S.number(F.col(col)).isNotNull().cast("double")) <= 0.9).alias("is_text")).scalar()


def binary_label(df: DataFrame, col: str, out: str = "label") -> DataFrame:
    """0/1 label: words or "1" for text columns, anything above zero for numeric ones."""
    staged = df.withColumn("_is_text", label_is_text(df, col))
    picked = F.when(F.col("_is_text"), S.label_from_text(F.col(col).cast("string"))).otherwise(S.label_from_number(F.col(col)))
    return staged.withColumn(out, picked).drop("_is_text")


def clean_flows(raw: DataFrame, leaky: Sequence[str] = tuple(LEAKY_COLUMNS), carry: Sequence[str] = ()) -> DataFrame:
    """Raw capture rows to the clean flow table: roles, label, class, numeric features, audit-only copies.

    Rows without a start time are dropped. ``carry`` keeps key columns such as ``flow_id`` as they are.
    Two passes: one aggregation to a single row decides the time unit, the kind of label and the feature
    columns; the second is a projection.
    """
    roles = require_roles(raw.columns)
    candidates = feature_candidates(raw.columns, carry, leaky)
    filled = lambda c: F.avg(S.number(F.col(c)).isNotNull().cast("double"))
    facts = raw.agg(
        time_unit(F.col(roles["start_time"])).alias("unit"), (filled(roles["label"]) <= 0.9).alias("is_text"),
        *[filled(c).alias(f"share__{c}") for c in candidates],
    ).first()
    features = [c for c in candidates if (facts[f"share__{c}"] or 0.0) >= 0.5]
    label_cell = F.col(roles["label"])
    label = S.label_from_text(label_cell.cast("string")) if facts["is_text"] else S.label_from_number(label_cell)
    df = raw.withColumns({"_start": in_epoch_ms(F.col(roles["start_time"]), F.lit(facts["unit"])), "_label": label})
    attack = F.col(roles["attack"]).cast("string") if "attack" in roles else None
    port = lambda role: S.port_number(F.col(roles[role])) if role in roles else F.lit(0)
    if "protocol" in roles and roles["protocol"] in features:
        flags = {f"proto_is_{n}": S.protocol_flag(F.col(roles["protocol"]), v) for n, v in S.PROTOCOLS.items()}
    else:
        flags = {}
    size = {r: S.safe_numeric(F.col(roles[r])) for r in ("in_bytes", "out_bytes") if r in roles}
    return df.where(F.col("_start").isNotNull()).select(
        *carry,
        F.col(roles["src_ip"]).cast("string").alias("src_ip"),
        F.col(roles["dst_ip"]).cast("string").alias("dst_ip"),
        port("src_port").alias("src_port"),
        port("dst_port").alias("dst_port"),
        F.col("_start").alias("start_ms"),
        F.col("_label").alias("label"),
        S.attack_class(attack, F.col("_label")).alias("attack"),
        S.total_bytes(size.get("in_bytes"), size.get("out_bytes")).alias("total_bytes"),
        *[S.safe_numeric(F.col(c)).alias(f"feature__{c}") for c in features],
        *[f.alias(n) for n, f in flags.items()],
        *[F.coalesce(S.number(F.col(c)), F.lit(0.0)).alias(f"probe__{c}") for c in leaky_columns(raw.columns, leaky)],
    )


def class_index(df: DataFrame, col: str = "attack") -> DataFrame:
    """Class name to number: Benign is 0, the others count up in alphabetical order.

    The unpartitioned rank runs over the distinct class names only.
    """
    names = df.select(col).distinct()
    if_missing = names.sparkSession.createDataFrame([(S.BENIGN,)], f"{col} string")
    names = names.union(if_missing).distinct()
    order = Window.orderBy(F.col(col) != S.BENIGN, F.col(col))
    return names.select(col, (F.row_number().over(order) - 1).cast("int").alias("target"))


def with_target(df: DataFrame, classes: DataFrame, col: str = "attack") -> DataFrame:
    return df.join(classes, col)


def heavy_tailed(name: str) -> bool:
    """Does the name say bytes, packets, times and the like? Indicators of a protocol never do."""
    return not name.startswith("proto_is_") and re.search(HEAVY_TAIL, name, re.IGNORECASE) is not None


def log_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """log(1 + max(x, 0)) on the heavy-tailed columns among ``columns``."""
    return df.withColumns({c: S.log1p_clip(F.col(c)) for c in filter(heavy_tailed, columns)})


def drop_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    return df.drop(*names)


def clip_at_train_max(nodes: DataFrame, col: str, train_nodes: DataFrame) -> DataFrame:
    """Cap a node column at the largest value it takes in training windows."""
    top = train_nodes.agg(F.max(col).alias("top")).scalar()
    return nodes.withColumn("_top", top).withColumn(col, F.least(F.col(col), F.coalesce("_top", F.col(col)))).drop("_top")


def infinite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which any of the columns is infinite: count and share."""
    any_infinite = F.greatest(*[F.coalesce(S.is_infinite(S.number(F.col(c))), F.lit(False)).cast("int") for c in columns])
    return df.agg(F.sum(any_infinite).alias("infinite_rows"), F.avg(any_infinite.cast("double")).alias("infinite_share"))


def constant_features(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Columns whose sample standard deviation is (almost) zero."""
    wide = df.agg(*[F.stddev_samp(S.safe_numeric(F.col(c))).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column_name", "deviation").where(F.col("deviation") < tolerance)


def timed_rows(df: DataFrame, id_col: str = "flow_id") -> DataFrame:
    """Rows with a start time, in time order; the id breaks ties so that the order is total."""
    return df.where(F.col("start_ms").isNotNull()).orderBy("start_ms", id_col)


def time_span_hours(df: DataFrame) -> DataFrame:
    return df.agg(((F.max("start_ms") - F.min("start_ms")) / 3.6e6).alias("hours"))


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flows and attacks per composite key; grouping needs no concatenated key text."""
    return df.groupBy(*keys).agg(F.count("*").alias("flows"), F.sum("label").alias("attacks"))


def written_classes(df: DataFrame, col: str = "attack") -> DataFrame:
    return cut(class_index(df, col), "classes")
