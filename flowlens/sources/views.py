"""Flow views over the star-schema test tables, and deterministic scored predictions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import scalars as S

DAY_SECONDS = 86_400
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
MODELS = {"forest": 0.35, "boost": 0.25, "plain": 0.10}
SEEDS = [1, 2, 3]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def address(nation: Column) -> Column:
    """An address per nation; every fifth one is public."""
    n = nation.cast("string")
    return F.when(nation % 5 == 0, F.concat(F.lit("8.8."), n, F.lit(".1"))).otherwise(F.concat(F.lit("10.0."), n, F.lit(".1")))


def _cents(name: str) -> Column:
    return S.rounded(F.col(name) * 100, 0).cast("bigint")


def joined_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the nations of its customer and supplier. Orders meet their customers first, so that lines move for one join only."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    placed = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        lines.join(placed.select("o_orderkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(*LINE, "c_nationkey", "s_nationkey")
    )


def _micros() -> Column:
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', l_shipdate)")


def start_ms_of_line() -> Column:
    return _micros() / 1000.0


def attack_of_line() -> Column:
    kind = F.col("l_linenumber") % 3
    return F.when(F.col("l_returnflag") == "R", F.concat_ws("-", "l_linestatus", kind.cast("string"))).otherwise(F.lit(S.BENIGN))


def flows_of_lines(joined: DataFrame, *carry: str) -> DataFrame:
    """The lines of ``joined_lineitem`` as flows, with further columns of it."""
    kind = F.col("l_linenumber") % 3
    return joined.select(
        F.md5(
            F.concat_ws(
                "|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", _cents("l_quantity"),
                _cents("l_extendedprice"), _cents("l_discount"), _cents("l_tax"), "l_returnflag", "l_linestatus", _micros(),
            )
        ).alias("flow_id"),
        address(F.col("c_nationkey")).alias("src_ip"),
        address(F.col("s_nationkey")).alias("dst_ip"),
        (F.col("l_orderkey") % 65536).cast("int").alias("src_port"),
        (F.col("l_partkey") % 1024).cast("int").alias("dst_port"),
        F.when(kind == 0, 6).when(kind == 1, 17).otherwise(1).alias("protocol"),
        start_ms_of_line().alias("start_ms"),
        (F.col("l_quantity") * 3600000.0).alias("duration_ms"),
        F.col("l_extendedprice").alias("in_bytes"),
        F.col("l_quantity").alias("out_bytes"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        attack_of_line().alias("attack"),
        *FEATURES,
        *carry,
    )


def flows_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders ⋈ customer ⋈ supplier read as flows from customer nations to supplier nations."""
    return flows_of_lines(joined_lineitem(spark, sf_dir))


def flows_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events read as flows from users to event types."""
    return events_as_flows(table(spark, sf_dir, "events"))


def events_as_flows(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").cast("string").alias("flow_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src_ip"),
        F.col("event_type").alias("dst_ip"),
        F.lit(0).alias("src_port"),
        F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)).alias("dst_port"),
        S.epoch_ms_of_ntz("ts").alias("start_ms"),
        F.col("value").alias("in_bytes"),
        F.lit(0.0).alias("out_bytes"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.when(F.col("event_type") == "error", "error").otherwise(S.BENIGN).alias("attack"),
    )


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineitem flows under raw header names and as text, the way a capture export arrives."""
    f = flows_lineitem(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    return f.select(
        "flow_id",
        F.col("src_ip").alias("IPV4_SRC_ADDR"), F.col("dst_ip").alias("IPV4_DST_ADDR"),
        text("src_port").alias("L4_SRC_PORT"),
        F.when(F.col("dst_port") % 7 == 0, F.lit("n/a")).otherwise(text("dst_port")).alias("L4_DST_PORT"),
        text("protocol").alias("PROTOCOL"),
        F.col("start_ms").cast("bigint").cast("string").alias("FLOW_START_MILLISECONDS"),
        F.when(F.col("label") == 1, F.lit(" Attack ")).otherwise(F.lit("0")).alias("Label"),
        F.when((F.col("label") == 0) & (F.col("protocol") == 6), F.lit("-")).otherwise(F.col("attack")).alias("Attack"),
        F.when(F.col("src_port") % 11 == 0, F.lit("inf"))
        .when(F.col("src_port") % 13 == 0, F.lit("bad"))
        .otherwise(F.round(F.col("in_bytes")).cast("bigint").cast("string")).alias("IN_BYTES"),
        F.col("out_bytes").cast("bigint").cast("string").alias("OUT_BYTES"),
        (F.col("duration_ms")).cast("bigint").cast("string").alias("FLOW_DURATION_MILLISECONDS"),
        (F.col("dst_port") % 256).cast("string").alias("MIN_TTL"),
        F.when(F.col("l_discount") == 0, F.lit("inf"))
        .otherwise(F.round(F.col("l_discount") * 100).cast("bigint").cast("string")).alias("SRC_TO_DST_SECOND_BYTES"),
        F.when(F.col("src_port") % 4 == 0, F.lit("7")).otherwise(F.lit("text")).alias("MOSTLY_TEXT"),
        F.lit("5").alias("CONSTANT"),
    )


def scored(flows: DataFrame, n_classes: int, models: dict[str, float] = MODELS, seeds: list[int] = SEEDS) -> DataFrame:
    """Deterministic class scores per model and seed, from a digest of (model, seed, flow), leaning to the truth.

    ``flows`` needs flow_id, target and the columns to carry on; one row per flow, model and seed comes out.
    """
    runs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed"), F.lit(lean).alias("lean"))
                  for m, lean in models.items() for s in seeds])
    )
    # Each run is a fixed projection of the flow row, so this explode is a bounded widening (models x seeds).
    wide = flows.withColumn("_run", runs).select("*", "_run.*").drop("_run")
    digest = F.md5(F.concat_ws(":", "model", F.col("seed").cast("string"), "flow_id"))
    # Four hex digits of the digest per class, read three classes at a time. One column per class: they compile, as functions over arrays do not.
    parts = {f"_p{g}": S.hash_int(F.col("_h"), 1 + 12 * g, 4 * min(3, n_classes - 3 * g)) for g in range(-(-n_classes // 3))}
    digits = [F.shiftright(f"_p{c // 3}", 16 * (min(3, n_classes - c // 3 * 3) - 1 - c % 3)).bitwiseAND(F.lit(65535)) for c in range(n_classes)]
    raw = {f"_r{c}": d / 65536.0 + F.when(F.col("target") == c, F.col("lean")).otherwise(0.0) for c, d in enumerate(digits)}
    total = sum((F.col(r) for r in list(raw)[1:]), F.col("_r0"))
    wide = wide.withColumn("_h", digest).withColumns(parts).withColumns(raw).withColumn("_t", total)
    wide = wide.withColumn("scores", F.array(*[S.rounded(F.col(r) / F.col("_t"), 4) for r in raw])).withColumn("y_pred", S.first_argmax(F.col("scores")))
    return wide.drop("_h", "_t", *parts, *raw, "lean")
