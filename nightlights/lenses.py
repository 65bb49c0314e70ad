"""The given tables seen as this library's tables, in SQL that Spark and other engines read alike."""

from __future__ import annotations

from string import Formatter

LENSES = {
    "curves": "SELECT CAST(CAST(ts AS DATE) AS STRING) AS night, CAST(row_number() OVER (PARTITION BY user_id % 8, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS INT) AS obs_idx, ts, CAST(user_id % 8 AS INT) AS source, value AS lum, event_type FROM {events}",
    "edges": "SELECT night, obs_idx, ts, source, lum, event_type = 'signup' AS is_on, event_type = 'error' AS is_off FROM {curves}",
    "gappy": "SELECT night, obs_idx, source, CASE WHEN lum >= 5 THEN lum END AS lum FROM {curves}",
    "source_class": "SELECT CAST(c_custkey % 8 AS INT) AS source, max_by(c_mktsegment, c_acctbal * 1000000 + c_custkey) AS lamp_class, CAST(avg(c_acctbal + 1000) / 11000 AS DOUBLE) AS score FROM {customer} GROUP BY 1",
    "pixels": "SELECT CAST(year(l_shipdate) AS STRING) AS night, CAST(month(l_shipdate) - 1 AS INT) AS obs_idx, CAST(l_partkey % 16 AS INT) AS r, CAST(l_suppkey % 16 AS INT) AS c, avg(l_quantity) AS lum FROM {lineitem} GROUP BY 1, 2, 3, 4",
    "labels": "SELECT DISTINCT CAST(l_partkey % 16 AS INT) AS r, CAST(l_suppkey % 16 AS INT) AS c, CAST(1 + 4 * floor((l_partkey % 16) / 4) + floor((l_suppkey % 16) / 4) AS INT) AS label FROM {lineitem} WHERE (l_partkey % 16 + l_suppkey % 16) % 5 <> 0",
    "scans": "SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS scan_id, CAST(year(l_shipdate) AS STRING) AS night, CAST(l_partkey % 16 AS INT) AS r, CAST(l_suppkey % 16 AS INT) AS c, CAST(l_linenumber - 1 AS INT) AS channel, CAST(sum(l_quantity) AS INT) AS value FROM {lineitem} GROUP BY 1, 2, 3, 4, 5",
    "scan_clock": "SELECT DISTINCT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS scan_id, make_timestamp(2024, 1, 1 + CAST((12 * year(l_shipdate) + month(l_shipdate)) % 30 AS INT), CAST((2 * month(l_shipdate) + 15) % 24 AS INT), 0, 0.0) AS ts FROM {lineitem}",
    "scan_times": "SELECT event_id AS scan_id, ts FROM {events} WHERE event_type = 'purchase'",
    "spectra": "SELECT CAST(vec_id AS INT) AS source, embedding AS spectrum, label AS lamp_class FROM {embeddings}",
    "points": "SELECT CAST(l_linenumber AS INT) AS tile, l_extendedprice / 1000 AS x, l_quantity AS y, l_discount * 100 AS z FROM {lineitem}",
    "pairs": "SELECT p_brand AS frame, p_partkey AS id, CAST(p_size AS DOUBLE) AS r0, (p_retailprice - 900) / 2 AS c0, 1.1 * (cos(0.1) * p_size - sin(0.1) * (p_retailprice - 900) / 2) + 5 + 0.01 * (p_partkey % 7 - 3) AS r1, 1.1 * (sin(0.1) * p_size + cos(0.1) * (p_retailprice - 900) / 2) - 3 + 0.01 * (p_partkey % 7 - 3) AS c1 FROM {part}",
    "detections": "SELECT concat('f', CAST(CAST(floor(p_partkey / 60) AS INT) AS STRING)) AS frame, CAST(p_partkey % 60 AS INT) AS id, CAST(10 * ((13 * (p_partkey % 60)) % 50) + p_size / 25.0 AS DOUBLE) AS r, CAST(37 * (p_partkey % 60) % 500 + p_size % 7 / 4.0 AS DOUBLE) AS c FROM {part}",
    "catalog": "SELECT CAST(floor(id / 8) AS INT) AS k, r + 0.5 AS r, c + 0.5 AS c FROM {detections} WHERE frame = 'f0' AND id % 8 = 3 AND id < 56",
    "lots": "SELECT CAST(s_suppkey + 1 AS BIGINT) AS bbl, CAST(4 * s_nationkey + 2.1 AS DOUBLE) AS x, CAST(4 * (s_suppkey % 13) + 2.33 AS DOUBLE) AS y FROM {supplier}",
    "places": "SELECT DISTINCT round(x, 1) AS x, y FROM {points}",
}


def needed(text: str) -> list[str]:
    """Names that a lens reads."""
    return list(dict.fromkeys(x for _, x, _, _ in Formatter().parse(text) if x))
