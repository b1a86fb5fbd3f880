"""Queries: sources, cleaning, column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import addresses as A
from flowlens.functions import scalars as S
from flowlens.operators import columns as C
from flowlens.plans.base import kept, windowed
from flowlens.plans.oracle import big, r6
from flowlens.plans.registry import query
from flowlens.sources import flows as IO
from flowlens.sources import views as V
from flowlens.tables import new_path


@query("read_flows_csv", f"SELECT count(*) AS flows, count(DISTINCT flow_id) AS ids, {big('sum(CAST(out_bytes AS BIGINT))')} AS bytes_out FROM flows")
def _(spark, sf):
    path = new_path(spark, "csv")
    V.raw_flows(spark, sf).write.option("header", True).csv(path)
    df = IO.read_flows(spark, path, ["flow_id", "OUT_BYTES"])
    per_id = df.groupBy("flow_id").agg(F.count("*").alias("n"), F.sum(S.number(F.col("OUT_BYTES"))).alias("b"))
    return per_id.agg(F.sum("n").alias("flows"), F.count("*").alias("ids"), F.sum("b").cast("bigint").alias("bytes_out"))


@query("column_pruned_scan", f"SELECT src_ip, dst_ip, count(*) AS flows, {r6('sum(in_bytes)')} AS in_bytes FROM flows GROUP BY ALL")
def _(spark, sf):
    df = V.flows_lineitem(spark, sf).select("src_ip", "dst_ip", "in_bytes")
    return df.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("flows"), S.r6(F.sum("in_bytes")).alias("in_bytes"))


@query("write_load_flows", "SELECT flow_id, src_ip, dst_ip, window_id, attack FROM kept")
def _(spark, sf):
    path = new_path(spark, "flows")
    IO.write_flows(kept(spark, sf), path, days=False)
    return IO.load_flows(spark, path, ["flow_id", "src_ip", "dst_ip", "window_id", "attack"])


_DAY = (803_347_200_000.0, 803_433_600_000.0)  # 17 June 1995, UTC


@query("load_flows_of_a_day", f"SELECT flow_id, src_ip, dst_ip, attack, {r6('start_ms')} AS start_ms FROM kept WHERE start_ms >= {_DAY[0]} AND start_ms < {_DAY[1]}")
def _(spark, sf):
    path = new_path(spark, "flow_days")
    IO.write_flows(kept(spark, sf).select("flow_id", "src_ip", "dst_ip", "attack", "start_ms"), path)
    return IO.load_flows(spark, path, between=_DAY).withColumn("start_ms", S.r6(F.col("start_ms"))).select("flow_id", "src_ip", "dst_ip", "attack", "start_ms")


@query("write_load_graphs", """
  SELECT window_id, flow_id, src_ip AS src, dst_ip AS dst, n AS nodes FROM kept JOIN (SELECT window_id, count(*) AS n FROM hosts GROUP BY window_id) USING (window_id)""")
def _(spark, sf):
    from flowlens.operators import graph as G

    path = new_path(spark, "graphs")
    df = kept(spark, sf)
    IO.write_graphs(G.edges(df), G.nodes(df), path)
    edges, nodes = IO.load_graphs(spark, path)
    return edges.join(nodes.groupBy("window_id").agg(F.count("*").alias("nodes")), "window_id").select("window_id", "flow_id", "src", "dst", "nodes")


@query("write_load_predictions", "SELECT flow_id, seed, y_true, y_pred FROM pred WHERE model = 'forest' AND seed IN (1, 3)")
def _(spark, sf):
    from flowlens.plans.base import predictions

    path = new_path(spark, "predictions")
    IO.write_predictions(predictions(spark, sf).select("model", "seed", "flow_id", "window_id", "y_true", "y_pred", "scores"), path)
    return IO.load_predictions(spark, path, "forest", [1, 3]).select("flow_id", "seed", "y_true", "y_pred")


@query("load_runs", f"SELECT model, seed, {r6('macro_f1')} AS macro_f1, {r6('macro_f1_attacks')} AS macro_f1_attacks FROM runmacro")
def _(spark, sf):
    from flowlens.operators import metrics as E
    from flowlens.plans.base import predictions

    path = new_path(spark, "runs")
    IO.write_runs(E.run_records(E.per_class_prf(E.class_counts(predictions(spark, sf)), n_classes=7)), path)
    runs = IO.load_runs(spark, path)
    return runs.select(
        "model", "seed", S.r6(F.col("metrics")["macro_f1"]).alias("macro_f1"), S.r6(F.col("metrics")["macro_f1_attacks"]).alias("macro_f1_attacks")
    )


@query("resolve_columns", """
  SELECT role, coalesce(column_name, 'NOT FOUND') AS column_name, flows FROM (VALUES ('src_ip', 'IPV4_SRC_ADDR'), ('dst_ip', 'IPV4_DST_ADDR'),
  ('src_port', 'L4_SRC_PORT'), ('dst_port', 'L4_DST_PORT'), ('protocol', 'PROTOCOL'), ('start_time', 'FLOW_START_MILLISECONDS'),
  ('end_time', NULL), ('label', 'Label'), ('attack', 'Attack'), ('in_bytes', 'IN_BYTES'), ('out_bytes', 'OUT_BYTES'),
  ('in_pkts', NULL), ('out_pkts', NULL)) r(role, column_name), (SELECT count(*) AS flows FROM flows)""")
def _(spark, sf):
    raw = V.raw_flows(spark, sf)
    report = C.column_report(raw).select("role", "column_name")
    return report.withColumn("flows", raw.agg(F.count("*").alias("n")).scalar())


@query("column_report", """
  SELECT role, CASE WHEN role IN ('src_ip', 'dst_ip', 'src_port', 'dst_port', 'protocol', 'in_bytes', 'out_bytes', 'label', 'attack')
         THEN role ELSE 'NOT FOUND' END AS column_name, CASE WHEN role = 'start_time' THEN 1 ELSE 0 END AS missing_required
  FROM (SELECT unnest(['src_ip', 'dst_ip', 'src_port', 'dst_port', 'protocol', 'start_time', 'end_time', 'label', 'attack',
                       'in_bytes', 'out_bytes', 'in_pkts', 'out_pkts']) AS role)""")
def _(spark, sf):
    # The clean view calls its time column start_ms, which is not a header alias: the report says so.
    return C.column_report(V.flows_lineitem(spark, sf))


@query("to_epoch_ms", f"""
  SELECT unit, count(*) AS flows, {r6('min(ms)')} AS first_ms, {r6('max(ms)')} AS last_ms, {r6('avg(ms)')} AS mean_ms
  FROM (SELECT CAST(unnest(['iso', 'ms', 'ns', 's', 'text', 'us']) AS VARCHAR) AS unit, floor(start_ms / 1000) * 1000 AS ms FROM flows) GROUP BY ALL""")
def _(spark, sf):
    f = V.flows_lineitem(spark, sf).select(F.floor(F.col("start_ms") / 1000).alias("s"))
    forms = {
        "s": F.col("s").cast("string"),
        "ms": (F.col("s") * 1000).cast("string"),
        "us": (F.col("s") * 1000000).cast("string"),
        "ns": (F.col("s") * 1000000000).cast("string"),
        "iso": F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "text": F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd HH:mm:ss"),
    }
    out = None
    for unit, text in forms.items():
        ms = C.epoch_ms(f.select(text.alias("t")), "t", "ms")
        part = ms.agg(F.count("*").alias("flows"), S.r6(F.min("ms")).alias("first_ms"), S.r6(F.max("ms")).alias("last_ms"), S.r6(F.avg("ms")).alias("mean_ms"))
        part = part.select(F.lit(unit).alias("unit"), "flows", "first_ms", "last_ms", "mean_ms")
        out = part if out is None else out.unionByName(part)
    return out


_SAFE = "CASE WHEN src_port % 11 = 0 OR src_port % 13 = 0 THEN 0 ELSE round(in_bytes) END"


@query("safe_numeric", f"SELECT flow_id, {r6(_SAFE)} AS in_bytes, CASE WHEN dst_port % 7 = 0 THEN 0 ELSE dst_port END AS dst_port FROM flows")
def _(spark, sf):
    raw = V.raw_flows(spark, sf)
    return raw.select("flow_id", S.r6(S.safe_numeric(F.col("IN_BYTES"))).alias("in_bytes"), S.port_number(F.col("L4_DST_PORT")).alias("dst_port"))


@query("binary_label", "SELECT flow_id, label, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS label_number FROM flows")
def _(spark, sf):
    raw = V.raw_flows(spark, sf).withColumn("number", F.greatest(F.col("OUT_BYTES").cast("double") - 25, F.lit(0)))
    both = C.binary_label(C.binary_label(raw, "Label", "label_text"), "number", "label_number")
    return both.select("flow_id", F.col("label_text").alias("label"), "label_number")


@query("attack_class", "SELECT flow_id, attack, CASE WHEN label = 1 THEN 'Attack' ELSE 'Benign' END AS without_column FROM flows")
def _(spark, sf):
    raw = C.binary_label(V.raw_flows(spark, sf), "Label", "label_code")
    code = F.col("label_code")
    return raw.select("flow_id", S.attack_class(F.col("Attack"), code).alias("attack"), S.attack_class(None, code).alias("without_column"))


@query("select_feature_columns", """
  SELECT column_name, round(share, 6) + 0.0::DOUBLE AS numeric_share FROM (
    SELECT 'PROTOCOL' AS column_name, 1.0::DOUBLE AS share UNION ALL SELECT 'OUT_BYTES', 1 UNION ALL SELECT 'FLOW_DURATION_MILLISECONDS', 1
    UNION ALL SELECT 'CONSTANT', 1 UNION ALL SELECT 'IN_BYTES', avg(CASE WHEN TRY_CAST(IN_BYTES AS DOUBLE) IS NULL THEN 0.0 ELSE 1.0 END) FROM raw)""")
def _(spark, sf):
    raw = V.raw_flows(spark, sf)
    names = C.select_feature_columns(raw, exclude=["flow_id"])
    return C.numeric_shares(raw, names).withColumn("numeric_share", S.r6(F.col("numeric_share")))


@query("leaky_columns", f"""
  SELECT flow_id, {r6('CAST(MIN_TTL AS DOUBLE)')} AS "probe__MIN_TTL", CASE WHEN SRC_TO_DST_SECOND_BYTES = 'inf' THEN 1 ELSE 0 END AS rate_infinite FROM raw""")
def _(spark, sf):
    clean = C.clean_flows(V.raw_flows(spark, sf), carry=["flow_id"])
    return clean.select(
        "flow_id", S.r6(F.col("probe__MIN_TTL")).alias("probe__MIN_TTL"),
        S.is_infinite(F.col("probe__SRC_TO_DST_SECOND_BYTES")).cast("int").alias("rate_infinite"),
    )


@query("protocol_indicators", """
  SELECT flow_id, CASE WHEN protocol = 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS proto_is_tcp, CASE WHEN protocol = 17 THEN 1.0 ELSE 0.0 END::DOUBLE AS proto_is_udp,
         CASE WHEN protocol = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS proto_is_icmp FROM flows""")
def _(spark, sf):
    return C.protocol_indicators(V.raw_flows(spark, sf), "PROTOCOL").select("flow_id", "proto_is_tcp", "proto_is_udp", "proto_is_icmp")


@query("clean_flows", f"""
  SELECT flow_id, src_ip, dst_ip, src_port, CASE WHEN dst_port % 7 = 0 THEN 0 ELSE dst_port END AS dst_port, {r6('CAST(start_ms AS BIGINT)')} AS start_ms,
         label, attack, {r6(_SAFE + ' + CAST(out_bytes AS BIGINT)')} AS total_bytes FROM flows""")
def _(spark, sf):
    clean = C.clean_flows(V.raw_flows(spark, sf), carry=["flow_id"])
    return clean.select("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", S.r6(F.col("start_ms")).alias("start_ms"), "label", "attack", S.r6(F.col("total_bytes")).alias("total_bytes"))


@query("drop_untimed_rows", f"SELECT flow_id, {r6('start_ms')} AS start_ms FROM flows WHERE dst_port % 7 <> 0")
def _(spark, sf):
    f = V.flows_lineitem(spark, sf)
    broken = F.when(F.col("dst_port") % 7 == 0, F.lit("?")).otherwise(F.col("start_ms").cast("bigint").cast("string"))
    return C.timed_rows(f.select("flow_id", S.number(broken).alias("start_ms"))).withColumn("start_ms", S.r6(F.col("start_ms")))


@query("class_index", "SELECT attack, target FROM cls")
def _(spark, sf):
    return C.class_index(V.flows_lineitem(spark, sf))


@query("log_transform", f"""
  SELECT flow_id, {r6('ln(1 + greatest(duration_ms, 0))')} AS "FLOW_DURATION_MILLISECONDS", {r6('ln(1 + out_bytes)')} AS "OUT_BYTES", {r6('dst_port - 100')} AS "DNS_QUERY_ID",
         {r6('ln(1 + greatest(in_bytes - 20000, 0))')} AS "IN_PKTS" FROM flows""")
def _(spark, sf):
    f = V.flows_lineitem(spark, sf).select(
        "flow_id", F.col("duration_ms").alias("FLOW_DURATION_MILLISECONDS"), F.col("out_bytes").alias("OUT_BYTES"),
        (F.col("dst_port") - 100).cast("double").alias("DNS_QUERY_ID"), (F.col("in_bytes") - 20000).alias("IN_PKTS"),
    )
    names = f.columns[1:]
    return C.log_transform(f, names).select("flow_id", *[S.r6(F.col(c)).alias(c) for c in names])


@query("is_private", f"""
  SELECT host, CASE WHEN host LIKE '10.%' THEN 1.0 ELSE 0.0 END::DOUBLE AS private, CASE WHEN host LIKE '10.%' THEN 1.0 ELSE 0.0 END::DOUBLE AS private_v6, CASE WHEN host LIKE '10.%' THEN 1.0 ELSE 0.0 END::DOUBLE AS private_mapped, count(*) AS flows FROM
  (SELECT src_ip AS host FROM flows UNION ALL SELECT dst_ip FROM flows) GROUP BY ALL""")
def _(spark, sf):
    f = V.flows_lineitem(spark, sf)
    hosts = f.select(F.explode(F.array("src_ip", "dst_ip")).alias("host")).groupBy("host").agg(F.count("*").alias("flows"))
    v6 = F.when(F.col("host").startswith("10."), F.lit("fd00::1")).otherwise(F.lit("2606:4700::1111"))
    return hosts.select("host", A.is_private(F.col("host")).alias("private"), A.is_private(v6).alias("private_v6"), A.is_private(F.concat(F.lit("::ffff:"), "host")).alias("private_mapped"), "flows")


@query("is_service_port", """
  SELECT dst_port, count(*) AS flows FROM flows WHERE dst_port IN (20, 21, 22, 23, 25, 53, 67, 68, 69, 80, 110, 123, 137, 138, 139, 143,
  161, 389, 443, 445, 465, 514, 587, 631, 993, 995, 1433, 1521, 3306, 3389, 5432, 5900, 8080, 8443) GROUP BY ALL""")
def _(spark, sf):
    f = V.flows_lineitem(spark, sf).where(S.is_service_port(F.col("dst_port")))
    return f.groupBy("dst_port").agg(F.count("*").alias("flows"))


@query("total_bytes", f"SELECT flow_id, {r6('coalesce(in_bytes, 0) + coalesce(out_bytes, 0)')} AS total_bytes, {r6('coalesce(in_bytes, 0)')} AS in_only FROM flows")
def _(spark, sf):
    f = V.flows_lineitem(spark, sf)
    return f.select("flow_id", S.r6(S.total_bytes(F.col("in_bytes"), F.col("out_bytes"))).alias("total_bytes"), S.r6(S.total_bytes(F.col("in_bytes"), None)).alias("in_only"))


@query("time_of_day", f"""
  SELECT window_id, {r6('sin(2 * pi() * a)')} AS tod_sin, {r6('cos(2 * pi() * a)')} AS tod_cos FROM
  (SELECT w AS window_id, ((min(start_ms) / 1000.0::DOUBLE) % 86400.0::DOUBLE) / 86400.0::DOUBLE AS a FROM
   (SELECT *, CAST(floor((start_ms - (SELECT min(start_ms) FROM ev)) / 3600000.0::DOUBLE) AS BIGINT) AS w FROM ev) GROUP BY w)""")
def _(spark, sf):
    from flowlens.operators import context as X
    from flowlens.operators import windows as W

    return X.time_context(W.assign_windows(V.flows_events(spark, sf), 3600)).select(
        "window_id", S.r6(F.col("tod_sin")).alias("tod_sin"), S.r6(F.col("tod_cos")).alias("tod_cos")
    )


@query("minute_of_day", "SELECT CAST(floor(start_ms / 60000) AS BIGINT) % 1440 AS minute, count(*) AS flows FROM ev GROUP BY ALL")
def _(spark, sf):
    return V.flows_events(spark, sf).groupBy(S.minute_of_day(F.col("start_ms")).alias("minute")).agg(F.count("*").alias("flows"))


@query("drop_features", f"SELECT flow_id, {r6('l_quantity')} AS l_quantity, {r6('l_tax')} AS l_tax FROM flows")
def _(spark, sf):
    f = V.flows_lineitem(spark, sf).select("flow_id", *V.FEATURES)
    return C.drop_features(f, ["l_extendedprice", "l_discount"]).select("flow_id", *[S.r6(F.col(c)).alias(c) for c in ("l_quantity", "l_tax")])


@query("clip_at_train_max", f"""
  SELECT window_id, host, {r6('least(ln(1 + flows_in + flows_out), (SELECT max(ln(1 + flows_in + flows_out)) FROM hosts JOIN winsplit USING (window_id) WHERE split = 0))')} AS size FROM hosts""")
def _(spark, sf):
    from flowlens.operators import graph as G
    from flowlens.plans.base import window_splits

    flows = windowed(spark, sf)
    table = window_splits(flows)
    nodes = G.host_counts(G.endpoints(G.pair_table(flows.join(table, "window_id"))))
    nodes = nodes.select("window_id", "host", F.log1p(F.col("flows_in") + F.col("flows_out")).alias("size"))
    train = nodes.join(table.where(F.col("split") == 0), "window_id", "left_semi")
    return C.clip_at_train_max(nodes, "size", train).select("window_id", "host", S.r6(F.col("size")).alias("size"))


@query("clip_extreme", f"""
  SELECT flow_id, {r6("CASE WHEN l_discount = 0 THEN 1e30 WHEN dst_port % 7 = 0 THEN 0 ELSE least(in_bytes, 50000) END")} AS clipped FROM flows""")
def _(spark, sf):
    f = V.flows_lineitem(spark, sf)
    wild = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).when(F.col("dst_port") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("in_bytes"))
    bounded = F.when(F.col("l_discount") == 0, S.clip_extreme(wild)).otherwise(S.clip_extreme(wild, 50000.0))
    return f.select("flow_id", S.r6(bounded).alias("clipped"))


@query("infinite_rows", f"""
  SELECT {big("sum(CASE WHEN SRC_TO_DST_SECOND_BYTES = 'inf' OR IN_BYTES = 'inf' THEN 1 ELSE 0 END)")} AS infinite_rows,
         {r6("avg(CASE WHEN SRC_TO_DST_SECOND_BYTES = 'inf' OR IN_BYTES = 'inf' THEN 1.0 ELSE 0.0 END)")} AS infinite_share FROM raw""")
def _(spark, sf):
    out = C.infinite_rows(V.raw_flows(spark, sf), ["SRC_TO_DST_SECOND_BYTES", "IN_BYTES"])
    return out.select("infinite_rows", S.r6(F.col("infinite_share")).alias("infinite_share"))


@query("composite_keys", f"SELECT src_ip, dst_ip, dst_port, count(*) AS flows, {big('sum(label)')} AS attacks FROM flows GROUP BY ALL")
def _(spark, sf):
    return C.key_counts(V.flows_lineitem(spark, sf), ["src_ip", "dst_ip", "dst_port"])


@query("constant_features", f"SELECT 'CONSTANT' AS column_name, {r6('stddev_samp(5.0::DOUBLE)')} AS deviation FROM flows")
def _(spark, sf):
    raw = V.raw_flows(spark, sf)
    names = C.select_feature_columns(raw, exclude=["flow_id"])
    return C.constant_features(raw, names).select("column_name", S.r6(F.col("deviation")).alias("deviation"))


@query("calendar_day", f"""
  SELECT strftime(make_timestamp(CAST(floor(start_ms / 86400000.0::DOUBLE) AS BIGINT) * 86400000000), '%Y-%m-%d') AS day, count(*) AS flows,
         strftime(make_timestamp(CAST(min(start_ms) * 1000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS first_flow FROM ev GROUP BY day""")
def _(spark, sf):
    f = V.flows_events(spark, sf)
    per_day = f.groupBy(S.to_day(F.col("start_ms")).alias("day")).agg(F.count("*").alias("flows"), F.min("start_ms").alias("s"))
    return per_day.select("day", "flows", F.date_format(S.to_timestamp(F.col("s")), "yyyy-MM-dd HH:mm:ss").alias("first_flow"))


@query("time_span_hours", f"SELECT {r6('(max(start_ms) - min(start_ms)) / 3600000.0::DOUBLE')} AS hours FROM flows")
def _(spark, sf):
    return C.time_span_hours(V.flows_lineitem(spark, sf)).select(S.r6(F.col("hours")).alias("hours"))
