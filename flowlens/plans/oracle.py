"""Building blocks of the checking SQL: named subqueries that are pulled in when a query mentions them."""

from __future__ import annotations

import re

from flowlens.sources.views import MODELS, SEEDS

N_CLASSES = 7


def r6(expr: str) -> str:
    return f"(round(CAST(({expr}) AS DOUBLE), 6) + 0.0)"


def big(expr: str) -> str:
    return f"CAST(({expr}) AS BIGINT)"


def _address(n: str) -> str:
    return f"CASE WHEN {n} % 5 = 0 THEN '8.8.' || {n} || '.1' ELSE '10.0.' || {n} || '.1' END"


_RUNS = ", ".join(f"('{m}', {s}, {lean}::DOUBLE)" for m, lean in MODELS.items() for s in SEEDS)
_RAW = ", ".join(
    f"('0x' || substr(h, {1 + 4 * c}, 4))::BIGINT / 65536.0::DOUBLE + CASE WHEN target = {c} THEN lean ELSE 0.0::DOUBLE END"
    for c in range(N_CLASSES)
)


def _scored(split: int) -> str:
    return f"""
      SELECT model, seed, flow_id, window_id, y_true, dst_ip, src_ip, scores,
             CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS y_pred
      FROM (SELECT *, list_transform(raw, lambda x: round(x / list_sum(raw), 4)) AS scores
            FROM (SELECT *, [{_RAW}] AS raw
                  FROM (SELECT model, seed, lean, flow_id, window_id, target, target AS y_true, src_ip, dst_ip,
                               md5(model || ':' || seed || ':' || flow_id) AS h
                        FROM lab, (VALUES {_RUNS}) AS r(model, seed, lean) WHERE split = {split})))"""


PARTS: dict[str, str] = {}

PARTS["flows"] = f"""
  SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_quantity * 100) AS BIGINT),
             CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT),
             CAST(round(l_tax * 100) AS BIGINT), l_returnflag, l_linestatus, epoch_us(l_shipdate))) AS flow_id,
         {_address('c_nationkey')} AS src_ip, {_address('s_nationkey')} AS dst_ip,
         CAST(l_orderkey % 65536 AS INTEGER) AS src_port, CAST(l_partkey % 1024 AS INTEGER) AS dst_port,
         CASE l_linenumber % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS protocol,
         epoch_us(l_shipdate) / 1000.0::DOUBLE AS start_ms, l_quantity * 3600000.0::DOUBLE AS duration_ms,
         l_extendedprice AS in_bytes, l_quantity AS out_bytes,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         CASE WHEN l_returnflag = 'R' THEN l_linestatus || '-' || (l_linenumber % 3) ELSE 'Benign' END AS attack,
         l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey"""
PARTS["ev"] = """
  SELECT CAST(event_id AS VARCHAR) AS flow_id, 'u' || user_id AS src_ip, event_type AS dst_ip,
         coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS dst_port,
         epoch_us(ts) / 1000.0::DOUBLE AS start_ms, value AS in_bytes, 0.0::DOUBLE AS out_bytes,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'Benign' END AS attack
  FROM events"""
PARTS["raw"] = """
  SELECT flow_id, src_ip AS IPV4_SRC_ADDR, dst_ip AS IPV4_DST_ADDR, CAST(src_port AS VARCHAR) AS L4_SRC_PORT,
         CASE WHEN dst_port % 7 = 0 THEN 'n/a' ELSE CAST(dst_port AS VARCHAR) END AS L4_DST_PORT,
         CAST(protocol AS VARCHAR) AS PROTOCOL, CAST(CAST(start_ms AS BIGINT) AS VARCHAR) AS FLOW_START_MILLISECONDS,
         CASE WHEN label = 1 THEN ' Attack ' ELSE '0' END AS Label,
         CASE WHEN label = 0 AND protocol = 6 THEN '-' ELSE attack END AS Attack,
         CASE WHEN src_port % 11 = 0 THEN 'inf' WHEN src_port % 13 = 0 THEN 'bad'
              ELSE CAST(CAST(round(in_bytes) AS BIGINT) AS VARCHAR) END AS IN_BYTES,
         CAST(CAST(out_bytes AS BIGINT) AS VARCHAR) AS OUT_BYTES,
         CAST(CAST(duration_ms AS BIGINT) AS VARCHAR) AS FLOW_DURATION_MILLISECONDS,
         CAST(dst_port % 256 AS VARCHAR) AS MIN_TTL,
         CASE WHEN l_discount = 0 THEN 'inf' ELSE CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) END AS SRC_TO_DST_SECOND_BYTES,
         CASE WHEN src_port % 4 = 0 THEN '7' ELSE 'text' END AS MOSTLY_TEXT, '5' AS "CONSTANT"
  FROM flows"""
PARTS["wf"] = """
  SELECT *, CAST(floor((start_ms - (SELECT min(start_ms) FROM flows)) / 86400000.0::DOUBLE) AS BIGINT) AS window_id FROM flows"""
PARTS["kept"] = """
  SELECT * FROM wf WHERE window_id IN (SELECT window_id FROM wf GROUP BY window_id HAVING count(*) >= 2)"""
PARTS["win"] = """
  SELECT window_id, row_number() OVER (ORDER BY window_id) - 1 AS pos, count(*) OVER () AS n_windows
  FROM (SELECT DISTINCT window_id FROM kept)"""
PARTS["winsplit"] = """
  SELECT window_id, pos, n_windows,
         CASE WHEN pos < CAST(floor(n_windows * 0.7::DOUBLE) AS BIGINT) THEN 0
              WHEN pos < CAST(floor(n_windows * 0.7::DOUBLE) AS BIGINT) + CAST(floor(n_windows * 0.1::DOUBLE) AS BIGINT) THEN 1
              ELSE 2 END AS split FROM win"""
PARTS["cls"] = """
  SELECT attack, CAST(row_number() OVER (ORDER BY attack <> 'Benign', attack) - 1 AS INTEGER) AS target
  FROM (SELECT DISTINCT attack FROM flows)"""
PARTS["lab"] = """
  SELECT kept.*, target, split, pos FROM kept JOIN cls USING (attack) JOIN winsplit USING (window_id)"""
PARTS["pred"] = _scored(2)
PARTS["valpred"] = _scored(1)
# Host side of every flow: a self-loop appears on both sides.
PARTS["ends"] = """
  SELECT window_id, src_ip AS host, dst_ip AS peer, 1 AS is_src, dst_port, in_bytes + out_bytes AS bytes FROM kept
  UNION ALL
  SELECT window_id, dst_ip, src_ip, 0, dst_port, in_bytes + out_bytes FROM kept"""
PARTS["hosts"] = """
  SELECT window_id, host, sum(1 - is_src) AS flows_in, sum(is_src) AS flows_out, count(DISTINCT peer) AS peers,
         sum(bytes) AS bytes, count(DISTINCT CASE WHEN is_src = 1 THEN dst_port END) AS ports
  FROM ends GROUP BY ALL"""
PARTS["obs"] = """
  SELECT host, window_id, row_number() OVER (PARTITION BY host ORDER BY window_id) AS rn,
         ln(1 + flows_in + flows_out) AS x1, ln(1 + bytes) AS x2, ln(1 + ports) AS x3, ln(1 + peers) AS x4 FROM hosts"""


def _fold() -> str:
    first = ", ".join(f"x{i} AS m{i}, 1.0::DOUBLE AS v{i}, 0.0::DOUBLE AS z{i}" for i in range(1, 5))
    step = ", ".join(
        f"e.m{i} + 0.3::DOUBLE * (o.x{i} - e.m{i}), 0.7::DOUBLE * (e.v{i} + 0.3::DOUBLE * (o.x{i} - e.m{i}) * (o.x{i} - e.m{i})),"
        f" least(greatest((o.x{i} - e.m{i}) / sqrt(greatest(e.v{i}, 1e-6)), -10.0), 10.0)"
        for i in range(1, 5)
    )
    return f"""
  SELECT host, window_id, rn, {first} FROM obs WHERE rn = 1
  UNION ALL
  SELECT o.host, o.window_id, o.rn, {step} FROM ewma e JOIN obs o ON o.host = e.host AND o.rn = e.rn + 1"""


PARTS["ewma"] = _fold()
PARTS["firsts"] = "SELECT host, peer, min(window_id) AS first_window FROM ends GROUP BY ALL"
PARTS["novelty"] = """
  SELECT window_id, host, avg(CASE WHEN window_id = first_window THEN 1.0 ELSE 0.0 END) AS peer_novelty
  FROM (SELECT DISTINCT window_id, host, peer FROM ends) JOIN firsts USING (host, peer) GROUP BY ALL"""
PARTS["pairs"] = "SELECT window_id, src_ip AS src, dst_ip AS dst, count(*) AS w FROM kept GROUP BY ALL"
PARTS["undirected"] = """
  SELECT DISTINCT window_id, least(src, dst) AS a, greatest(src, dst) AS b FROM pairs WHERE src <> dst"""
PARTS["tri"] = """
  SELECT x.window_id, x.a, x.b, y.b AS c FROM undirected x JOIN undirected y ON x.window_id = y.window_id AND x.b = y.a
  JOIN undirected z ON z.window_id = x.window_id AND z.a = x.a AND z.b = y.b"""
PARTS["clust"] = """
  SELECT h.window_id, h.host, coalesce(t.n, 0) AS triangles, coalesce(d.k, 0) AS k,
         CASE WHEN coalesce(d.k, 0) >= 2 THEN coalesce(t.n, 0) / (d.k * (d.k - 1) / 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS clustering
  FROM hosts h
  LEFT JOIN (SELECT window_id, host, count(*) AS k FROM (SELECT window_id, a AS host FROM undirected UNION ALL
             SELECT window_id, b FROM undirected) GROUP BY ALL) d USING (window_id, host)
  LEFT JOIN (SELECT window_id, host, count(*) AS n FROM (SELECT window_id, a AS host FROM tri UNION ALL
             SELECT window_id, b FROM tri UNION ALL SELECT window_id, c FROM tri) GROUP BY ALL) t USING (window_id, host)"""
PARTS["prnodes"] = """
  SELECT h.window_id, h.host, count(*) OVER (PARTITION BY h.window_id) AS n, o.out_w FROM hosts h
  LEFT JOIN (SELECT window_id, src AS host, sum(w) AS out_w FROM pairs GROUP BY ALL) o USING (window_id, host)"""
PARTS["pr0"] = "SELECT window_id, host, n, out_w, 1.0::DOUBLE / n AS rank FROM prnodes"
for _i in range(1, 31):
    _p = f"pr{_i - 1}"
    PARTS[f"pr{_i}"] = f"""
  SELECT window_id, host, n, out_w, raw / sum(raw) OVER (PARTITION BY window_id) AS rank FROM (
    SELECT p.window_id, p.host, p.n, p.out_w,
           0.15::DOUBLE / p.n + 0.85::DOUBLE * coalesce(m.got, 0) +
           0.85::DOUBLE * coalesce(sum(CASE WHEN p.out_w IS NULL THEN p.rank END) OVER (PARTITION BY p.window_id), 0) / p.n AS raw
    FROM {_p} p LEFT JOIN (SELECT e.window_id, e.dst AS host, sum(q.rank * e.w / q.out_w) AS got
      FROM pairs e JOIN {_p} q ON q.window_id = e.window_id AND q.host = e.src GROUP BY ALL) m USING (window_id, host))"""
PARTS["portstat"] = """
  SELECT window_id, host, sum(n) AS sent, sum(CASE WHEN dst_port IN (20, 21, 22, 23, 25, 53, 67, 68, 69, 80, 110, 123, 137, 138,
           139, 143, 161, 389, 443, 445, 465, 514, 587, 631, 993, 995, 1433, 1521, 3306, 3389, 5432, 5900, 8080, 8443)
           THEN n ELSE 0 END) AS service, -sum(n / t * log2(n / t)) AS entropy
  FROM (SELECT *, sum(n) OVER (PARTITION BY window_id, host) AS t FROM
        (SELECT window_id, src_ip AS host, dst_port, CAST(count(*) AS DOUBLE) AS n FROM kept GROUP BY ALL)) GROUP BY ALL"""
PARTS["ctx"] = """
  SELECT h.window_id, h.host, ln(1 + flows_in) AS in_degree, ln(1 + flows_out) AS out_degree, ln(1 + peers) AS unique_peers,
         rank * n AS pagerank, clustering, z1 AS z_flows, z2 AS z_bytes, z3 AS z_ports, z4 AS z_peers,
         peer_novelty, ln(1 + h.window_id - min(h.window_id) OVER (PARTITION BY h.host)) AS log_age_windows,
         CASE WHEN rn = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_first_seen,
         CASE WHEN h.host LIKE '10.%' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_private,
         flows_in / (flows_in + flows_out)::DOUBLE AS inbound_ratio, coalesce(service / sent, 0)::DOUBLE AS server_port_share,
         coalesce(entropy, 0)::DOUBLE AS dst_port_entropy, ln(1 + flows_in + flows_out) AS log_total_flows
  FROM hosts h JOIN pr30 USING (window_id, host) JOIN clust USING (window_id, host) JOIN ewma USING (window_id, host)
       JOIN novelty USING (window_id, host) LEFT JOIN portstat USING (window_id, host)"""
# Per-class counts of every run, and the scores built on them.
PARTS["counts"] = """
  SELECT model, seed, class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
    SELECT model, seed, y_true AS class, CAST(y_true = y_pred AS INT) AS tp, 0 AS fp, CAST(y_true <> y_pred AS INT) AS fn FROM pred
    UNION ALL SELECT model, seed, y_pred, 0, 1, 0 FROM pred WHERE y_true <> y_pred) GROUP BY ALL"""
PARTS["prf"] = """
  SELECT model, seed, c.target AS class, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn,
         coalesce(tp, 0) + coalesce(fn, 0) AS support,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1
  FROM (SELECT DISTINCT model, seed FROM pred) r CROSS JOIN cls c LEFT JOIN counts k USING (model, seed)
  WHERE k.class = c.target OR k.class IS NULL"""
PARTS["runmacro"] = """
  SELECT model, seed, avg(f1) FILTER (support > 0) AS macro_f1, avg(f1) FILTER (support > 0 AND class > 0) AS macro_f1_attacks
  FROM prf GROUP BY ALL"""


RECURSIVE = {"ewma"}


def sql(text: str, extra: dict[str, str] | None = None) -> str:
    """``text`` with the definitions of every named part it (transitively) mentions in front."""
    parts = {**PARTS, **(extra or {})}
    needed: list[str] = []

    def visit(body: str, own: str = "") -> None:
        for name in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", body)):
            if name in parts and name != own and name not in needed:
                visit(parts[name], name)
                if name not in needed:
                    needed.append(name)

    visit(text)
    if not needed:
        return text.strip()
    recursive = "RECURSIVE " if RECURSIVE & set(needed) else ""
    with_list = ",\n".join(f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({parts[n].strip()})" for n in needed)
    return f"WITH {recursive}{with_list}\n{text.strip()}"
