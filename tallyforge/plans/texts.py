"""Queries on fields of JSON lines and on merged JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fields, merging, prefixes
from .catalogue import query
from .tables import table

_LINE = """l AS (SELECT event_id, user_id, event_type, props, '{"id":' || event_id || ',"note":"a:b,{}[] \\"q\\"","payload":{"cwd":"/home/' || user_id || '","props":' || props || CASE WHEN event_id % 4 = 0 THEN '' ELSE ',"deep":{"cwd":"' || event_type || '"}' END || '},"tags":["' || event_type || '",' || user_id || ',{"x":[1,2]}]}' AS line FROM events)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = """concat('{"id":', event_id, ',"note":"a:b,{}[] \\\\"q\\\\"","payload":{"cwd":"/home/', user_id, '","props":', props, if(event_id % 4 = 0, '', concat(',"deep":{"cwd":"', event_type, '"}')), '},"tags":["', event_type, '",', user_id, ',{"x":[1,2]}]}')"""
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", f"{line} as line")


@query(
    "field_scan",
    f"""WITH {_LINE} SELECT event_id, json_extract_string(line, '$.payload.cwd') AS cwd, json_extract_string(line, '$.note') AS note, json_extract_string(line, '$.payload.deep.cwd') AS deep, json_extract(line, '$.id')::VARCHAR AS id, json_extract(line, '$.payload.props')::VARCHAR AS props,
      json_extract(line, '$.tags')::VARCHAR AS tags FROM l""",
)
def field_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = {"cwd": ["payload", "cwd"], "note": ["note"], "deep": ["payload", "deep", "cwd"]}
    got = fields.with_fields(_lines(spark, sf_dir), "line", strings, {"id": ["id"], "props": ["payload", "props"], "tags": ["tags"]})
    # as they are written, which DuckDB's JSON is without white space
    return got.select("event_id", "cwd", "note", "deep", "id", F.replace("props", F.lit(" "), F.lit("")).alias("props"), "tags")


@query(
    "field_elements",
    f"""WITH {_LINE} SELECT event_id, CAST(unnest(range(0, 3)) AS INTEGER) AS pos, unnest(CAST(json_extract(line, ['$.tags[0]', '$.tags[1]', '$.tags[2]']) AS VARCHAR[])) AS element FROM l""",
)
def field_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = fields.with_fields(_lines(spark, sf_dir).select("event_id", "line"), "line", raws={"tags": ["tags"]}).select("event_id", "tags")
    return fields.with_fields(tags, "tags", arrays=["parts"]).select("event_id", F.posexplode("parts").alias("pos", "element"))


@query(
    "first_fields",
    """WITH f AS (SELECT user_id, event_id, CASE WHEN event_id % 5 > 0 THEN 'v' || event_id END AS cwd, CASE WHEN event_id % 7 = 0 THEN event_type END AS slug FROM events)
    SELECT user_id, arg_min(cwd, event_id) FILTER (cwd IS NOT NULL) AS cwd, arg_min(slug, event_id) FILTER (slug IS NOT NULL) AS slug FROM f GROUP BY 1""",
)
def first_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = """concat('{"x":{"cwd":"no"},', if(event_id % 5 > 0, concat('"cwd":"v', event_id, '"'), '"cwd":1'), if(event_id % 7 = 0, concat(',"slug":"', event_type, '"'), ''), '}')"""
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", f"{line} as line")
    return fields.first_fields(e, "user_id", "event_id", "line", ["cwd", "slug"])


_PAIRS = """p AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 2 = 0 AS later, '{"a":{"x":' || o_custkey || ',"y":[1,' || o_orderkey || ',"s"]},"b":' || CASE WHEN o_orderkey % 3 = 0 THEN '{"z":1}' ELSE '"w"' END || ',"only":true}' AS live,
    '{"new":{"n":null},"a":{"y":["s",' || o_custkey || ',1.0],"x":' || CASE WHEN o_orderkey % 5 = 0 THEN o_custkey ELSE o_custkey + 1 END || ',"w":[]},"b":"w"}' AS source FROM orders)"""
_MERGED = f"""WITH {_PAIRS}, q AS (SELECT *, k % 5 > 0 AS dx, k % 3 = 0 AS db, c NOT IN (1, k) AS more FROM p)"""


def _document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = """concat('{"a":{"x":', o_custkey, ',"y":[1,', o_orderkey, ',"s"]},"b":', if(o_orderkey % 3 = 0, '{"z":1}', '"w"'), ',"only":true}')"""
    source = """concat('{"new":{"n":null},"a":{"y":["s",', o_custkey, ',1.0],"x":', if(o_orderkey % 5 = 0, o_custkey, o_custkey + 1), ',"w":[]},"b":"w"}')"""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", f"{live} as live", f"{source} as source", "o_orderkey % 2 = 0 as source_later")


@query(
    "nested_merge",
    f"""{_MERGED} SELECT k, '{{"a":{{"x":' || CASE WHEN dx AND later THEN c + 1 ELSE c END || ',"y":[1,' || k || ',"s"' || CASE WHEN more THEN ',' || c ELSE '' END || '],"w":[]}},"b":' || CASE WHEN db AND NOT later THEN '{{"z":1}}' ELSE '"w"' END || ',"only":true,"new":{{"n":null}}}}' AS text,
      CAST(2 AS BIGINT) AS keys_added, CAST(more AS BIGINT) AS elements_added, CASE WHEN later THEN CAST(dx AS BIGINT) + CAST(db AS BIGINT) ELSE 0 END AS replaced, false AS covered FROM q""",
)
def nested_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merge(_document_pairs(spark, sf_dir), "k")[0]


@query(
    "nested_conflicts",
    f"""{_MERGED} SELECT k, '/a/x' AS pointer, CASE WHEN later THEN 'source' ELSE 'live' END AS kept_side, CAST(CASE WHEN later THEN c + 1 ELSE c END AS VARCHAR) AS kept, CAST(CASE WHEN later THEN c ELSE c + 1 END AS VARCHAR) AS other FROM q WHERE dx
    UNION ALL SELECT k, '/b', CASE WHEN later THEN 'source' ELSE 'live' END, CASE WHEN later THEN '"w"' ELSE '{{"z":1}}' END, CASE WHEN later THEN '{{"z":1}}' ELSE '"w"' END FROM q WHERE db""",
)
def nested_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merge(_document_pairs(spark, sf_dir), "k")[1]


# what the destination holds of each document: as it is, longer, cut, changed near the end, a link, a directory, nothing
_HELD = """f AS (SELECT doc_id AS key, coalesce(text, '') AS t FROM documents),
  d AS (SELECT key, CASE CAST(key % 9 AS INT) WHEN 5 THEN 'link' WHEN 6 THEN 'other' ELSE 'file' END AS kind, CASE CAST(key % 9 AS INT) WHEN 0 THEN t WHEN 1 THEN t || chr(10) || 'more' WHEN 2 THEN t[1:length(t) // 2] WHEN 3 THEN t[1:greatest(length(t) - 3, 0)] || '@@@@@' WHEN 4 THEN '@' || t ELSE 'x' END AS t FROM f WHERE key % 9 < 7),
  s AS (SELECT key, CASE WHEN key % 2 = 0 THEN t ELSE t || 'tail' END AS t FROM f WHERE key % 5 = 0)"""


def _contents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("t"))
    held = F.expr("case key % 9 when 0 then t when 1 then concat(t, '\\n', 'more') when 2 then substring(t, 1, length(t) div 2) when 3 then concat(substring(t, 1, greatest(length(t) - 3, 0)), '@@@@@') when 4 then concat('@', t) else 'x' end")
    kind = F.expr("case key % 9 when 5 then 'link' when 6 then 'other' else 'file' end")
    d = f.where("key % 9 < 7").select("key", kind.alias("kind"), held.cast("binary").alias("content"))
    s = f.where("key % 5 = 0").select("key", F.lit("file").alias("kind"), F.expr("if(key % 2 = 0, t, concat(t, 'tail'))").cast("binary").alias("content"))
    return f.select("key", F.col("t").cast("binary").alias("content")), d, s


@query(
    "key_fold_proof",
    f"""WITH {_HELD}, x AS (SELECT f.key, f.t, d.kind, d.t AS h, s.t AS b FROM f LEFT JOIN d USING (key) LEFT JOIN s USING (key)),
    w AS (SELECT *, kind = 'file' AND starts_with(h, t) AS main FROM x)
    SELECT key, CASE WHEN main THEN CASE WHEN h = t THEN 'identical' ELSE 'prefix-extended' END WHEN b IS NOT NULL THEN CASE WHEN b = t THEN 'identical-beside' ELSE 'prefix-extended-beside' END
      WHEN kind IS NULL THEN 'absent' WHEN kind = 'link' THEN 'dest-link' WHEN kind = 'other' THEN 'dest-other' ELSE 'differs' END AS status FROM w""",
)
def key_fold_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.proof(*_contents(spark, sf_dir), chunk=512)


_COMMON = """c AS (SELECT key, f.t AS a, d.t AS b FROM f JOIN d USING (key)), u AS (SELECT key, CASE WHEN starts_with(b, a) THEN a WHEN starts_with(a, b) THEN b WHEN key % 9 = 3 AND length(a) >= 3 THEN a[1:length(a) - 3] || CASE WHEN a[length(a) - 2:] = '@@@' THEN '@@@' WHEN a[length(a) - 2:length(a) - 1] = '@@' THEN '@@' WHEN a[length(a) - 2] = '@' THEN '@' ELSE '' END ELSE '' END AS p FROM c)"""


@query(
    "common_prefixes",
    f"""WITH {_HELD}, {_COMMON} SELECT key, strlen(p)::BIGINT AS bytes, strlen(CASE WHEN contains(p, chr(10)) THEN p[1:length(p) - length(regexp_extract(p, '[^\n]*$'))] ELSE '' END)::BIGINT AS line_bytes FROM u WHERE key % 9 IN (0, 1, 2, 3)""",
)
def common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, d, _ = _contents(spark, sf_dir)
    return prefixes.common(f, d.where("key % 9 in (0, 1, 2, 3)").select("key", "content"), chunk=512)


@query(
    "prefix_extensions",
    f"""WITH {_HELD}, x AS (SELECT f.key, f.t, d.t AS h FROM f LEFT JOIN d USING (key)) SELECT key, CASE WHEN h IS NULL THEN 'absent' WHEN h = t THEN 'same' WHEN starts_with(t, h) THEN 'extend' ELSE 'not-prefix' END AS state,
      CASE WHEN state = 'extend' THEN sha256(t[length(h) + 1:]) END AS tail_sha256 FROM x""",
)
def prefix_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, d, _ = _contents(spark, sf_dir)
    return prefixes.extensions(f, d.select("key", "content"), chunk=512).select("key", "state", F.sha2("tail", 256).alias("tail_sha256"))


@query(
    "key_fold_plan",
    f"""WITH {_HELD} SELECT f.key, CASE WHEN d.t IS NULL THEN 'fold-move' WHEN f.key % 4 = 1 THEN 'fold-union' WHEN d.t = f.t THEN 'fold-remove' ELSE 'fold-hold' END AS action FROM f LEFT JOIN d USING (key)""",
)
def key_fold_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, d, _ = _contents(spark, sf_dir)
    return prefixes.fold_plan(f.withColumn("append_log", F.expr("key % 4 = 1")), d.select("key", "content"), chunk=512)
