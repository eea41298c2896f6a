"""Queries on marks of names and texts, on places, and on proofs from ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs, marks, places, proofs
from .catalogue import query
from .tables import table


def _nth(key: str, values: list[str]) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(key) % len(values) + 1).cast("int"))


def _sql(key: str, values: list[str]) -> str:
    told = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{told}][CAST(({key}) % {len(values)} AS INT) + 1]"


_ERRORS = ["fatal: Could not resolve hostname x: timed out", "error: No space left on device; connection refused", "git@x: Permission denied (publickey).", "fatal: not a git repository", "error: object not found", "bash: warning: setlocale: is corrupt", "sh: 1: cd: no", "all is well", "ssh: connect: Connection refused"]
_SAYS = ["no_space" if "space" in e else "timeout" if "timed out" in e else "host_unreachable" if "refused" in e else "auth_failed" if "denied" in e else "not_a_repository" if "not a git" in e or ": cd: " in e else "bad_object" if "not found" in e else "other" for e in _ERRORS]


@query("stderr_classes", f"SELECT o_orderkey, {_sql('o_orderkey', _SAYS)} AS class FROM orders")
def stderr_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("line one\\n"), _nth("o_orderkey", _ERRORS), F.lit("\\nlast"))
    return table(spark, sf_dir, "orders").select("o_orderkey", marks.stderr_class(text).alias("class"))


@query(
    "redacted_notes",
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 11 = 0 THEN ' ghp_abc' ELSE '' END AS x FROM documents), f AS (SELECT doc_id, x, trim(regexp_replace(regexp_replace(x, '[^\x21-\x7E]', ' ', 'g'), ' +', ' ', 'g')) AS f,
      regexp_matches(x, 'ghp_|gho_|github_pat_|AGE-SECRET-KEY-|-----BEGIN|sk-|xoxb-|Bearer ') AS secret FROM t)
    SELECT doc_id, CASE WHEN secret THEN '<redacted>' WHEN length(f) > 160 THEN f[1:160] || '...' ELSE f END AS note FROM f""",
)
def redacted_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.expr("if(doc_id % 11 = 0, ' ghp_abc', '')"))
    return table(spark, sf_dir, "documents").select("doc_id", marks.note(text).alias("note"))


@query(
    "identifier_lines",
    r"""WITH l AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(line, '[^A-Za-z0-9._:/@=+,''()\[\]#*-]', ' ', 'g'), ' +', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS ls FROM documents)))
    SELECT doc_id, count(*) AS n, md5(string_agg(line, '|' ORDER BY i)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM l WHERE line <> '' AND length(line) <= 200 AND NOT regexp_matches(line, 'ghp_|gho_|github_pat_|AGE-SECRET-KEY-|-----BEGIN|sk-|xoxb-|Bearer ')) WHERE rn <= 256 GROUP BY 1""",
)
def identifier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", marks.identifier_lines(F.col("text")).alias("l")).where(F.size("l") > 0)
    return d.select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", "|")).alias("digest"))


_NAMES = [".tmp-0123456789abcdef-12-0", ".tmp-0123456789abcdef-d-12-3", ".tmp-12-3", ".tmp-012-3", ".tmp-0123456789abcdeF-1-2", "tmp-1-2", ".tmp-1", ".tmp-18446744073709551615-1", ".tmp-18446744073709551616-1", ".tmp-0123456789abcdef-d-1"]
_KINDS = ["file", "directory", "untagged", None, None, None, None, "untagged", None, None]


@query("temporary_names", f"SELECT p_partkey, nullif({_sql('p_partkey', [k or '' for k in _KINDS])}, '') AS kind, CASE WHEN kind IN ('file', 'directory') THEN '0123456789abcdef' END AS tag FROM part")
def temporary_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _nth("p_partkey", _NAMES)
    return table(spark, sf_dir, "part").select("p_partkey", marks.temporary(name, ".tmp-").alias("kind"), marks.temporary_tag(name, ".tmp-").alias("tag"))


_HEADS = ["ref: refs/heads/main", "{h}\n", "{h} {h} who", "{h}", "SQLite format 3", "", "{h}{h2}\nx", "{H}\n"]


@query("ref_like_heads", f"SELECT p_partkey, p_partkey % 8 IN (0, 1, 2, 6) AS is_ref, {_sql('p_partkey', ['t', 't', '', ''])} = 't' AS stored FROM part")
def ref_like_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, h2 = "0123456789" * 4, "0123456789abcdef01234567"
    heads = [x.replace("{h2}", h2).replace("{h}", h).replace("{H}", h.replace("9", "F")) for x in _HEADS]
    where = _nth("p_partkey", [".git/refs/heads/x-wal", "a/logs/b", "refs", "a/refsx/b"])
    return table(spark, sf_dir, "part").select("p_partkey", marks.looks_like_ref(_nth("p_partkey", heads)).alias("is_ref"), marks.ref_storage(where).alias("stored"))


@query(
    "line_marks",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '2026-01-' || event_id END AS stamp, event_id % 4 IN (0, 2) AND event_id % 3 > 0 AS ordinal,
      CASE WHEN event_id % 5 = 0 THEN '' ELSE 't:' || user_id || ',' END || 'c:q' || event_id AS ids FROM events""",
)
def line_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = """case event_id % 4 when 0 then concat('"timestamp":"2026-01-', event_id, '",') when 1 then '"timestamp":"a\\\\u0041",' when 2 then '' else repeat(' ', 90) end"""
    body = """concat(if(event_id % 3 > 0, '"ordinal":7,', ''), '"turn_id":"', if(event_id % 5 = 0, 'rollout-12', cast(user_id as string)), '","call_id":"q', event_id, '","x":"\\\\"turn_id\\\\":\\\\"no\\\\""')"""
    line = F.expr(f"concat('{{', {first}, {body}, '}}')")
    # an escape in the stamp makes it none, and what lies behind 96 bytes is no ordinal
    e = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return e.select("event_id", marks.leading_timestamp(F.col("line")).alias("stamp"), (marks.has_ordinal(F.col("line")) & F.expr("event_id % 4 <> 1")).alias("ordinal"), F.array_join(marks.tagged_ids(F.col("line")), ",").alias("ids"))


_TOKENS = ["7", "100", "101", "+5", "-1", "007", "", "5.0", "IO", "A_1", "a_1", "1A", "A-B"]


@query("validated_tokens", f"SELECT p_partkey, p_partkey % 13 IN (0, 1, 3, 5) AS percent, p_partkey % 13 IN (8, 9) AS code FROM part")
def validated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = _nth("p_partkey", _TOKENS)
    return table(spark, sf_dir, "part").select("p_partkey", marks.is_percent(token).alias("percent"), marks.is_code_token(token).alias("code"))


@query("mount_table", "SELECT s_suppkey, '8:' || s_nationkey AS device, '/' AS root, '/mnt/a b' || s_suppkey || chr(92) || 'x' AS point FROM supplier WHERE s_suppkey % 4 > 0")
def mount_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("concat('36 35 8:', s_nationkey, ' / ', '/mnt/a', chr(92), '040b', s_suppkey, chr(92), '134x', ' rw - ext4')")
    s = table(spark, sf_dir, "supplier").select(F.when(F.expr("s_suppkey % 4 = 0"), "short line").otherwise(line).alias("line"))
    return marks.mounts(s, "line").select(F.regexp_extract("point", "([0-9]+)", 1).cast("long").alias("s_suppkey"), "device", "root", "point")


_ENTRIES = {
    "git/old/x": "git-history", "git/mirrors/a": "git-admin", "git/r/.git/HEAD": "git-admin", "git/r.worktrees/a/b": "git-worktree", "git/r/.claude/worktrees/w/f": "git-worktree", "git/r/src/a.c": "git-checkout", "git": "git-checkout", "projects/s.db-wal": "sqlite", ".claude/x": "agents",
    ".ssh/id": "credentials", ".config/agent/k": "credentials", ".config/other": "dotfiles", "projects/node_modules/a": "node-modules", "projects/a": "projects", ".cache/z": "cache", "data/big": "large-data", "dotfiles/v": "dotfiles", "misc/a": "edge", "git/r/.claude/worktrees": "git-checkout",
}


@query("entry_classes", f"SELECT CASE WHEN p_partkey % 23 = 22 AND {_sql('p_partkey', list(_ENTRIES))} NOT LIKE 'git%' THEN 'sqlite' ELSE {_sql('p_partkey', list(_ENTRIES.values()))} END AS class, count(*) AS entries FROM part GROUP BY 1")
def entry_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cls = marks.entry_class(_nth("p_partkey", list(_ENTRIES)), F.lit("f"), F.expr("p_partkey % 23 = 22"), "git/old")
    return p.groupBy(cls.alias("class")).agg(F.count("*").alias("entries"))


_CAPTURES, _PRESENCE = ["held", "refused", "transient", "pending"], ["absent", "empty", "git", "not-git", "symlinked", "unreadable"]


@query(
    "move_actions",
    f"""WITH x AS (SELECT o_orderkey % 2 = 0 AS ws, {_sql('o_orderkey // 2', _CAPTURES)} AS c, {_sql('o_orderkey // 8', _PRESENCE)} AS p, o_orderkey % 3 = 0 AS seats FROM orders),
    y AS (SELECT CASE WHEN c = 'pending' THEN 'refuse:capture-pending' WHEN c = 'transient' THEN 'refuse:capture-transient' WHEN p = 'unreadable' THEN 'refuse:unreadable' WHEN p = 'symlinked' AND NOT (seats AND c = 'held') THEN 'refuse:symlinked-path'
      WHEN c = 'held' AND p = 'not-git' THEN 'refuse:not-git' WHEN c = 'held' AND p IN ('absent', 'empty') THEN CASE WHEN ws THEN 'land:absent' ELSE 'land:bare-landing' END WHEN c = 'held' THEN CASE WHEN ws THEN 'adopt:adopt-or-beside' ELSE 'refs-only:refs-only-adopt' END
      WHEN ws THEN 'refuse:capture-refused' ELSE 'refuse:capture-refused-refs-only' END AS a FROM x)
    SELECT split_part(a, ':', 1) AS action, split_part(a, ':', 2) AS reason, count(*) AS n FROM y GROUP BY 1, 2""",
)
def move_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    action, reason = marks.move_action(F.expr("o_orderkey % 2 = 0"), _nth("o_orderkey div 2", _CAPTURES), _nth("o_orderkey div 8", _PRESENCE), F.expr("o_orderkey % 3 = 0"))
    return table(spark, sf_dir, "orders").groupBy(action.alias("action"), reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    "routed_stores",
    """WITH p AS (SELECT 'd' || c_custkey // 8 || '/' || CASE WHEN c_custkey % 8 = 0 AND c_nationkey % 3 > 0 THEN 'state_' ELSE 's' END || c_custkey || '.sqlite' AS store, c_custkey AS k FROM customer),
    q AS (SELECT store, k * 4 AS seq, store AS path FROM p WHERE k % 5 > 0 UNION ALL SELECT store, k * 4 + 1, store || '-wal' FROM p WHERE k % 2 = 0 OR k % 5 = 0 UNION ALL SELECT store, k * 4 + 2, store || '-shm' FROM p WHERE k % 4 = 0),
    s AS (SELECT store, min(seq) AS seq, split_part(store, '/', 1) AS dir, contains(store, '/state_') AS state, coalesce(string_agg(path, ',' ORDER BY path) FILTER (path <> store), '') AS sidecars FROM q GROUP BY 1),
    c AS (SELECT dir, arg_min(store, seq) AS clock FROM s WHERE state GROUP BY 1)
    SELECT store, sidecars, CASE WHEN NOT state THEN clock END AS clock, state FROM s LEFT JOIN c USING (dir)""",
)
def routed_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr("concat('d', c_custkey div 8, '/', if(c_custkey % 8 = 0 and c_nationkey % 3 > 0, 'state_', 's'), c_custkey, '.sqlite')").alias("store"))
    seats = [("", "k % 5 > 0", 0), ("-wal", "k % 2 = 0 or k % 5 = 0", 1), ("-shm", "k % 4 = 0", 2)]
    out = None
    for tail, where, n in seats:
        one = p.where(where).select(F.concat("store", F.lit(tail)).alias("path"), (F.col("k") * 4 + n).alias("seq"))
        out = one if out is None else out.union(one)
    return places.routed(out).withColumn("sidecars", F.array_join("sidecars", ","))


_ROLL = "printf('%08d-0000-4000-8000-%012d', o_orderkey, o_orderkey)"


@query(
    "unindexed_files",
    f"""WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'other/' ELSE 'sessions/' END || 'rollout-' || {_ROLL} || CASE WHEN o_orderkey % 5 = 0 THEN '.txt' ELSE '.jsonl' END AS live FROM orders)
    SELECT live AS rel, live || CASE WHEN k % 4 = 1 THEN '.side' ELSE '' END AS landed, CASE WHEN k % 5 > 0 THEN substr(live, 18, 36) END AS id FROM f WHERE k % 7 > 0 AND k % 3 > 0
    UNION ALL SELECT live, live, CASE WHEN k % 5 > 0 THEN substr(live, 18, 36) END FROM f WHERE k % 7 > 0 AND k % 3 > 0 AND k % 4 = 1 AND k % 8 = 1""",
)
def unindexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "concat(if(o_orderkey % 7 = 0, 'other/', 'sessions/'), 'rollout-', format_string('%08d-0000-4000-8000-%012d', o_orderkey, o_orderkey), if(o_orderkey % 5 = 0, '.txt', '.jsonl')) as live")
    seats = f.selectExpr("concat(live, if(k % 4 = 1, '.side', '')) as path", "k % 4 = 2 as link").union(f.where("k % 4 = 1").selectExpr("live", "k % 8 <> 1"))
    return places.unindexed(seats, f.where("k % 3 = 0").select(F.col("live").alias("rel")), ["sessions"], ".side")


@query(
    "session_lanes",
    """WITH c AS (SELECT c_custkey AS k, '/home/u' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '/w' || c_custkey % 5 ELSE '' END AS p, c_custkey % 4 AS m FROM customer),
    x AS (SELECT *, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 1 THEN p || '/old' ELSE p END AS cwd, CASE CAST(m AS INT) WHEN 0 THEN regexp_replace(p, '[^A-Za-z0-9]', '-', 'g') WHEN 1 THEN '-srv-x' WHEN 2 THEN 'lane' || k % 25 ELSE '-home-u3' END AS key, k % 9 = 0 AS known FROM c),
    y AS (SELECT *, NOT known AND NOT (key = '-home-u3' OR starts_with(key, '-home-u3-')) AS own, regexp_replace(cwd, '[^A-Za-z0-9]', '-', 'g') = key AS at_key, CASE WHEN cwd LIKE '/home/u' || (k - k + 4) || '/%' OR cwd = '/home/u4' THEN 'lane4' WHEN cwd LIKE '/home/u7/w2%' THEN 'lane7w' WHEN cwd LIKE '/home/u7/%' OR cwd = '/home/u7' THEN 'lane7' END AS lane FROM x)
    SELECT k AS session, CASE WHEN cwd IS NULL THEN CASE WHEN own THEN 'in-place' ELSE 'refused' END WHEN lane = key THEN 'in-place' WHEN lane IS NULL AND at_key AND own THEN 'in-place' WHEN NOT at_key THEN CASE WHEN own THEN 'in-place' ELSE 'refused' END WHEN lane IS NOT NULL THEN 'lane' WHEN k % 2 = 0 THEN 'by-id' ELSE 'refused' END AS outcome,
      CASE WHEN outcome <> 'refused' THEN NULL WHEN cwd IS NULL OR NOT at_key THEN 'lane-unresolved' ELSE 'lane-unmapped' END AS reason, cwd, CASE WHEN outcome = 'lane' OR lane = key THEN lane END AS lane FROM y""",
)
def session_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "concat('/home/u', c_nationkey, if(c_custkey % 3 = 0, concat('/w', c_custkey % 5), '')) as p")
    key = F.expr("case k % 4 when 0 then regexp_replace(p, '[^A-Za-z0-9]', '-') when 1 then '-srv-x' when 2 then concat('lane', k % 25) else '-home-u3' end")
    s = c.select(
        F.col("k").alias("session"), key.alias("key"), F.expr("if(k % 11 = 0, null, p)").alias("cwd"), F.expr("case when k % 11 = 0 then '' when k % 13 = 1 then concat(p, '/old') end").alias("cached_cwd"), F.lit(True).alias("unchanged"), F.expr("k % 9 = 0").alias("known"), F.lit(False).alias("beside"),
        F.expr("k % 2 = 0").alias("by_id"),
    )
    lanes = spark.createDataFrame([("/home/u4", "lane4"), ("/home/u7", "lane7"), ("/home/u7/w2", "lane7w")], "owner string, target string")
    return places.sessions(s, lanes, True, "-home-u3")


_THREADS = """t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CASE WHEN c_custkey % 5 = 0 THEN 'rel' ELSE '' END || '/l' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '/in' ELSE '' END || CASE WHEN c_custkey % 7 = 0 THEN '/../x' ELSE '/a' END END AS cwd FROM customer),
  l AS (SELECT DISTINCT '/l' || n_nationkey AS link, '/real/' || n_nationkey AS real FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT '/l4/in', '/deep' UNION SELECT '/l6', '/l6')"""


@query(
    "respelled_rows",
    f"""WITH {_THREADS}, m AS (SELECT t.id, t.cwd AS old, l.link, l.real, row_number() OVER (PARTITION BY id ORDER BY length(link) DESC) AS rn FROM t JOIN (SELECT * FROM l WHERE link <> '/l6' OR real = '/l6') l ON t.cwd = l.link OR starts_with(t.cwd, l.link || '/'))
    SELECT id, old, real || substr(old, length(link) + 1) AS new FROM m WHERE rn = 1 AND NOT contains(old, '/../') AND real <> link AND id % 6 > 0""",
)
def respelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "if(c_custkey % 17 = 0, null, concat(if(c_custkey % 5 = 0, 'rel', ''), '/l', c_nationkey, if(c_custkey % 3 = 0, '/in', ''), if(c_custkey % 7 = 0, '/../x', '/a'))) as cwd")
    n = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0 and n_nationkey <> 6").selectExpr("concat('/l', n_nationkey) as link", "concat('/real/', n_nationkey) as real")
    links = n.union(spark.createDataFrame([("/l4/in", "/deep"), ("/l6", "/l6")], "link string, real string"))
    return places.respelled(t, links, t.where("id % 6 = 0"))


@query("links_to_roots", f"WITH {_THREADS} SELECT id AS path, cwd AS target FROM t WHERE cwd = '/l4/in' OR starts_with(cwd, '/l4/in/') OR starts_with(cwd, '/l9/')")
def links_to_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").selectExpr("c_custkey as path", "if(c_custkey % 17 = 0, null, concat(if(c_custkey % 5 = 0, 'rel', ''), '/l', c_nationkey, if(c_custkey % 3 = 0, '/in', ''), if(c_custkey % 7 = 0, '/../x', '/a'))) as target")
    return places.live_links(t.where("target is not null"), spark.createDataFrame([("/l4/in",), ("/l9",), ("/l",)], "root string"))


@query(
    "base_paths_corrected",
    """WITH b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '/keep/' ELSE '/src/' END || c_nationkey || '/r' || c_custkey AS r, CASE WHEN c_custkey % 5 = 0 THEN '/src/../x' WHEN c_custkey % 4 = 0 THEN '/keep' ELSE '/src/w' END AS c FROM customer),
    m AS (SELECT id, r, c, CASE WHEN r LIKE '/src/%' THEN '/dst/' || r[6:] ELSE r END AS nr, CASE WHEN c LIKE '/src/%' THEN '/dst/' || c[6:] ELSE c END AS nc FROM b),
    w AS (SELECT *, CASE WHEN id % 6 = 0 OR NOT (nr LIKE '/dst/%' OR id % 2 = 0) OR contains(nc, '/../') THEN 'base-path-unavailable' WHEN id % 7 = 0 THEN 'state-changed' ELSE 'base-path-corrected' END AS disposition FROM m WHERE nr <> r OR nc <> c)
    SELECT id, disposition, CASE WHEN disposition = 'base-path-corrected' THEN nr ELSE r END AS rollout_path, CASE WHEN disposition = 'base-path-corrected' THEN nc ELSE c END AS cwd FROM w""",
)
def base_paths_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "concat(if(c_custkey % 4 = 0, '/keep/', '/src/'), c_nationkey, '/r', c_custkey) as rollout_path", "case when c_custkey % 5 = 0 then '/src/../x' when c_custkey % 4 = 0 then '/keep' else '/src/w' end as cwd")
    dest = b.withColumn("cwd", F.expr("if(id % 7 = 0, 'moved', cwd)"))
    files = b.where("id % 6 > 0").select(F.regexp_replace("rollout_path", "^/src/", "/dst/").alias("path"))
    return places.corrected(b, dest, spark.createDataFrame([("/src", "/dst")], "owner string, target string"), files)


_ACTIONS = ["adopt", "covered", "rollout-covered", "consolidate", "rollout-extended"]


@query(
    "retire_plan",
    f"""WITH l AS (SELECT l_orderkey, l_linenumber AS seq, l_partkey % 3 AS key, CASE WHEN l_orderkey % 31 = 0 THEN '/abs/' WHEN l_orderkey % 29 = 0 THEN 'a/../' ELSE 'a/' END || l_orderkey || CASE WHEN l_orderkey % 37 = 0 THEN '.sqlite' ELSE '.jsonl' END AS path, l_linenumber % 5 > 0 AS regular, l_suppkey % 2 = 0 AS output FROM lineitem),
    a AS (SELECT l.*, coalesce(CASE WHEN l_orderkey % 4 > 0 THEN {_sql('l_orderkey', _ACTIONS)} END, CASE WHEN output THEN 'adopt' END) AS action FROM l WHERE regular AND NOT starts_with(path, '/') AND NOT contains(path, '..') AND path NOT LIKE '%.sqlite'),
    w AS (SELECT *, CASE WHEN action = 'consolidate' THEN 'its outcome (consolidate) proves no copy' WHEN action = 'rollout-covered' THEN CASE WHEN l_orderkey % 9 = 0 THEN 'no proof' WHEN (l_orderkey + key) % 2 = 0 THEN 'differs' END
      ELSE CASE WHEN l_orderkey % 8 = 0 THEN 'no proof' WHEN l_orderkey % 6 = 0 THEN 'gone' END END AS why FROM a WHERE action IS NOT NULL)
    SELECT path, CASE WHEN count(*) FILTER (why IS NULL) > 0 THEN 'retire' ELSE 'skipped' END AS verdict, count(*) FILTER (why IS NULL) AS allowed, CASE WHEN allowed = 0 THEN arg_max(why, seq) END AS why FROM w GROUP BY 1""",
)
def retire_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = "concat(case when l_orderkey % 31 = 0 then '/abs/' when l_orderkey % 29 = 0 then 'a/../' else 'a/' end, l_orderkey, if(l_orderkey % 37 = 0, '.sqlite', '.jsonl'))"
    l = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", f"{path} as path", "l_linenumber as seq", "if(l_linenumber % 5 > 0, 'regular', 'directory') as kind", "l_partkey % 3 as key", "l_suppkey % 2 = 0 as output")
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey as l_orderkey").selectExpr("l_orderkey", f"{path} as path")
    actions = o.where("l_orderkey % 4 > 0").select("path", _nth("l_orderkey", _ACTIONS).alias("action"))
    content = o.where("l_orderkey % 8 > 0").selectExpr("path", "cast(null as bigint) as key", "if(l_orderkey % 6 = 0, 'gone', null) as reason")
    record = o.where("l_orderkey % 9 > 0").selectExpr("l_orderkey", "path", "explode(array(0L, 1L, 2L)) as key").selectExpr("path", "key", "if((l_orderkey + key) % 2 = 0, 'differs', null) as reason")
    return proofs.retire_plan(l.drop("l_orderkey"), actions, content.union(record))


@query(
    "carry_proofs",
    """WITH i AS (SELECT o_orderkey AS k, '/s/' || o_custkey AS src, o_orderkey % 3 > 0 AS ws FROM orders WHERE o_orderkey % 2 = 0)
    SELECT k AS item, CASE WHEN k % 41 = 0 THEN 'carried-record-unreadable' WHEN k % 37 = 0 THEN 'carried-record-mismatch' WHEN k % 31 = 0 THEN 'carried-source-mismatch' WHEN ws AND k % 5 = 0 THEN 'carried-shape-mismatch' WHEN ws AND k % 29 = 0 THEN 'carried-destination-mismatch' WHEN NOT ws AND k % 5 > 0 THEN 'carried-shape-mismatch'
      WHEN k % 23 = 0 THEN 'carried-transfer-missing' WHEN k % 19 = 0 THEN 'carried-transfer-changed' WHEN k % 17 = 0 THEN 'carried-transfer-unreadable' WHEN k % 13 = 0 OR k % 43 = 0 THEN 'carried-transfer-mismatch' WHEN k % 11 = 0 THEN 'carried-transfer-refused-paths' WHEN k % 7 = 0 THEN 'carried-pointer-attached' END AS reason FROM i WHERE k % 4 = 0 OR k % 10 > 0""",
)
def carry_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey as item", "concat('/s/', o_custkey) as source", "o_orderkey % 3 > 0 as workspace", "concat('/d/', o_orderkey) as planned")
    have = i.where("item % 4 = 0 or item % 10 > 0")
    r = have.selectExpr(
        "item", "explode(array(1, 2)) as seq", "item % 41 > 0 as readable", "if(item % 37 = 0, 1, 2) as version", "item as record_item", "if(item % 31 = 0, 'x', source) as source", "if(item % 5 = 0, 1L, null) as via", "if(item % 29 = 0, '/e', planned) as destination", "item * 10 as transfer_item",
        "'d' as transfer_digest", "concat('host:', source) as transfer_source",
    )
    # the record of the earlier state is of no account
    r = r.withColumn("version", F.expr("if(seq = 1, 9, version)"))
    t = r.where("seq = 2 and item % 23 > 0").selectExpr("transfer_item", "if(item % 19 = 0, 'e', 'd') as digest", "item % 17 > 0 as readable", "if(item % 13 = 0, 'running', 'completed') as session", "transfer_item as session_item", "destination", "if(item % 43 = 0, source, transfer_source) as source")
    return proofs.carry_proof(i, r, t, r.where("item % 11 = 0").select("transfer_item"), r.where("item % 7 = 0").select("item"), 2)


@query(
    "coverage_rewrites",
    """WITH e AS (SELECT user_id AS k, event_id AS pos, event_type || event_id % 50 AS event, user_id % 2 = 0 AS ordinal, event_id % 6 AS m, 't:' || event_id % 9 AS id FROM events),
    s AS (SELECT * FROM e WHERE m < 4), t AS (SELECT k, pos, CASE WHEN k % 4 = 0 THEN event || 'r' ELSE event END AS event, k % 8 = 6 AS ordinal, id FROM e WHERE (k % 5 > 0 OR m < 4) AND (k % 3 > 0 OR pos % 11 > 0) AND k % 7 > 0),
    a AS (SELECT k, event, count(*) AS n FROM s GROUP BY ALL), b AS (SELECT k, event, count(*) AS n FROM t GROUP BY ALL), lack AS (SELECT a.k, sum(greatest(a.n - coalesce(b.n, 0), 0))::BIGINT AS lacking FROM a LEFT JOIN b ON a.k = b.k AND a.event = b.event GROUP BY 1),
    x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS i FROM s), y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS i FROM t),
    o AS (SELECT x.k, count(*) AS n_a, count(y.i) AS n_b, coalesce(bool_and(y.i IS NULL OR x.event = y.event), true) AS prefix FROM x LEFT JOIN y ON x.k = y.k AND x.i = y.i GROUP BY 1),
    more AS (SELECT k, count(*) AS n_t, bool_or(ordinal) AS o, sum(10 + 1) AS bytes FROM t GROUP BY 1), ids AS (SELECT s.k, count(DISTINCT s.id) AS ids, count(DISTINCT s.id) FILTER (NOT EXISTS (SELECT 1 FROM t WHERE t.k = s.k AND t.id = s.id)) AS missing FROM s GROUP BY 1),
    c AS (SELECT s.k, count(*) AS events, bool_and(ordinal) AS r, sum(10 + 1) AS bytes FROM s GROUP BY 1),
    v AS (SELECT c.k, events, lacking, ids, missing, c.bytes AS sb, more.bytes AS tb, c.r AND NOT coalesce(more.o, false) AS rewrite, CASE WHEN lacking = 0 THEN 'covered' WHEN prefix AND coalesce(n_t, 0) < n_a AND coalesce(n_t, 0) = n_b THEN 'extends' ELSE 'lacks' END AS p FROM c JOIN lack USING (k) JOIN o USING (k) LEFT JOIN more USING (k) JOIN ids USING (k))
    SELECT k, CASE WHEN greatest(sb, coalesce(tb, 0)) > 9000 THEN 'over-limit' WHEN p = 'lacks' AND rewrite AND missing = 0 THEN 'rewrite-covered' ELSE p END AS verdict, lacking, events, CASE WHEN p = 'lacks' AND rewrite THEN missing END AS missing_ids, ids FROM v""",
)
def coverage_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("user_id as k", "event_id as pos", "concat(event_type, event_id % 50) as event", "user_id % 2 = 0 as ordinal", "event_id % 6 as m", "array(concat('t:', event_id % 9)) as ids", "10 as size")
    t = e.where("(k % 5 > 0 or m < 4) and (k % 3 > 0 or pos % 11 > 0) and k % 7 > 0").selectExpr("k", "pos", "if(k % 4 = 0, concat(event, 'r'), event) as event", "k % 8 = 6 as ordinal", "ids", "size")
    return logs.coverage_of_logs(e.where("m < 4").drop("m"), t, "k", 9000)


@query("escaped_names", "SELECT doc_id, sha256(replace(t, 'b', chr(92) || 'x62')) AS told, true AS back FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^a-z ]', '', 'g')[1:500] AS t FROM documents)")
def escaped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("bare", F.substring(F.regexp_replace("text", "[^a-z ]", ""), 1, 500).cast("binary"))
    # what a writer escaped beyond need is read as well, and every text comes back
    d = d.withColumns({"told": F.replace(marks.escaped(F.col("bare")), F.lit("b"), F.lit("\\x62")), "whole": marks.escaped(F.col("text").cast("binary"))})
    back = (marks.unescaped(F.col("whole")) == F.col("text").cast("binary")) & (marks.unescaped(F.col("told")) == F.col("bare"))
    return d.select("doc_id", F.sha2("told", 256).alias("told"), back.alias("back"))


@query("refusal_typing", f"SELECT o_orderkey, {_sql('o_orderkey', ['C1', 'IO', 'OLD', 'FRAME_CODEC', 'C2'])} AS code, o_orderkey % 5 IN (0, 4) AS typed, o_orderkey % 5 = 2 AS retired FROM orders")
def refusal_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _nth("o_orderkey", ["C1", "IO", "OLD", "FRAME_CODEC", "C2"]).alias("code"))
    return marks.typed_refusals(rows, "code", spark.createDataFrame([(c,) for c in ("C1", "C2", "IO", "FRAME_CODEC", "C1")], "code string"))


@query(
    "repository_inventory",
    """WITH c AS (SELECT c_custkey AS k, 'h/' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '/in' ELSE '' END || '/p' || c_custkey AS p FROM customer), r AS (SELECT p AS root, CASE CAST(k % 4 AS INT) WHEN 0 THEN 'main' WHEN 1 THEN 'linked' WHEN 2 THEN 'bare' END AS kind FROM c WHERE k % 4 < 3
      UNION ALL SELECT DISTINCT 'h/' || c_nationkey, 'main' FROM customer WHERE c_nationkey % 2 = 0)
    SELECT root, kind, CASE WHEN root LIKE 'h/%/%' AND split_part(root, '/', 2)::INT % 2 = 0 THEN 'h/' || split_part(root, '/', 2) END AS nested_in FROM r""",
)
def repository_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "c_nationkey as n", "concat('h/', c_nationkey, if(c_custkey % 3 = 0, '/in', ''), '/p', c_custkey) as p")
    kinds = [("k % 4 = 0", "/.git", "directory"), ("k % 4 = 0", "/.git/HEAD", "regular"), ("k % 4 = 0", "/.git/objects", "directory"), ("k % 4 = 0", "/.git/refs", "directory"), ("k % 4 = 1", "/.git", "regular"), ("k % 4 = 2", "/HEAD", "regular"), ("k % 4 = 2", "/objects", "directory"), ("k % 4 = 2", "/refs", "directory"), ("k % 4 = 3", "/HEAD", "regular")]
    e = c.where("n % 2 = 0").selectExpr("concat('h/', n, '/.git') as path", "'directory' as kind")
    for where, tail, kind in kinds:
        e = e.union(c.where(where).select(F.concat("p", F.lit(tail)).alias("path"), F.lit(kind).alias("kind")))
    return places.repositories(e)


@query(
    "record_entries",
    "SELECT DISTINCT l_orderkey AS session, 'f' || l_partkey % 9 AS path, l_returnflag AS outcome FROM lineitem",
)
def record_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as session", "concat('f', l_partkey % 9) as path", "l_returnflag as outcome")
    return proofs.transfer_entries(l.groupBy("session").agg(F.collect_list(F.struct("path", "outcome")).alias("entries")))


@query(
    "ledger_entries",
    """WITH o AS (SELECT o_orderkey AS item, o_custkey AS c FROM orders)
    SELECT item, 's' || c AS source, item % 2 = 0 AS has_workspace, CASE WHEN item % 3 > 0 THEN 'ok' END AS record, CASE WHEN item % 3 > 0 THEN 's' || c END AS record_source, CASE WHEN item % 3 > 0 THEN CASE WHEN item % 6 > 3 THEN 'captured' ELSE 'refs-imported' END END AS outcome, CAST(NULL AS VARCHAR) AS refusal,
      CASE WHEN item % 5 = 0 THEN 'pending' END AS beside, CASE WHEN item % 7 = 0 THEN 'ok' END AS carried, CASE WHEN item % 7 = 0 THEN 's' || c END AS carried_source, CASE WHEN item % 7 = 0 THEN c END AS carried_via,
      CASE WHEN item % 11 = 0 THEN 'no-capture' WHEN item % 11 = 1 THEN 'unreadable' WHEN item % 4 = 0 THEN 'refs-imported' ELSE 'absent' END AS journal FROM o""",
)
def ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey as item", "o_custkey as c", "concat('s', o_custkey) as source")
    # an earlier state's record, and the one that counts
    old = o.where("item % 3 > 0").selectExpr("item", "1 as seq", "'outcome-record-unreadable' as record", "'x' as record_source", "'refused' as outcome", "'IO' as refusal")
    outcomes = o.where("item % 3 > 0").selectExpr("item", "2 as seq", "'ok' as record", "source as record_source", "if(item % 6 > 3, 'captured', 'refs-imported') as outcome", "cast(null as string) as refusal").union(old)
    captures = o.where("item % 11 > 0").selectExpr("item", "explode(array(1, 2)) as seq").selectExpr("item", "seq", "seq = 1 or item % 11 > 1 as readable")
    return proofs.ledger_entries(
        o.selectExpr("item", "source", "item % 2 = 0 as has_workspace"), outcomes, o.where("item % 4 = 0").selectExpr("item", "1 as seq", "'refs-imported' as body"), captures, o.where("item % 5 = 0").selectExpr("item", "1 as seq", "'pending' as verdict"),
        o.where("item % 7 = 0").selectExpr("item", "1 as seq", "'ok' as verdict", "source", "c as via"),
    )
