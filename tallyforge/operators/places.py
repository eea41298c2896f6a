"""Where stores, sessions and links belong: routing, unindexed files, lanes, spellings through links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import ancestors, mapped, owners, project_key


def routed(paths: DataFrame) -> DataFrame:
    """(store, sidecars, clock, state) of paths(path): each store with the sidecars among them, whether its own seat is there or not; a store that is
    no state store has the first state store of its directory, in the order of paths(seq), as its clock. Ordered by state first, then by store."""
    store = F.regexp_replace("path", "-(wal|shm|journal)$", "")
    x = paths.select("path", "seq", store.alias("store")).groupBy("store").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_set(F.when(F.col("path") != F.col("store"), F.col("path")))).alias("sidecars"))
    dir_ = F.regexp_extract("store", "^(?:(.*)/)?[^/]*$", 1)
    x = x.withColumn("dir", dir_).withColumn("state", F.regexp_extract("store", "([^/]*)$", 1).startswith("state_"))
    clocks = x.where("state").groupBy("dir").agg(F.min_by("store", "seq").alias("clock"))
    return x.join(clocks, "dir", "left").select("store", "sidecars", F.when(~F.col("state"), F.col("clock")).alias("clock"), "state").orderBy(F.desc("state"), "store")


def unindexed(files: DataFrame, named: DataFrame, trees: list[str], suffix: str | None = None) -> DataFrame:
    """(rel, landed, id) of files(path, link) under the trees that no row of named(rel) names.

    With a suffix, a copy beside a live path stands under the live name, and a link with such a copy is left to it. id: the uuid that ends a log's name.
    """
    of = None
    for tree in trees:
        one = F.col("path").startswith(f"{tree}/")
        of = one if of is None else of | one
    x = files.where(of)
    beside = F.col("path").endswith(suffix) if suffix else F.lit(False)
    x = x.withColumn("rel", F.when(beside, F.expr(f"substring(path, 1, length(path) - {len(suffix or '')})")).otherwise(F.col("path"))).withColumn("_beside", beside)
    if suffix:
        copies = x.where("_beside").select("rel", F.lit(True).alias("_copy")).distinct()
        x = x.join(copies, "rel", "left").where(~(F.col("link") & ~F.col("_beside") & F.coalesce("_copy", F.lit(False))))
    stem = F.regexp_extract("rel", r"([0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})\.jsonl(?:\.zst|\.gz)?$", 1)
    return x.join(named.select("rel").distinct(), "rel", "left_anti").select("rel", F.col("path").alias("landed"), F.nullif(stem, F.lit("")).alias("id"))


def sessions(candidates: DataFrame, lanes: DataFrame, live: bool, home_key: str) -> DataFrame:
    """(session, outcome, reason, cwd, lane): where each transcript belongs.

    candidates: session, key (of the directory it lies in), cwd (the first in its lines, null without), cached_cwd (of an earlier pass: null if none, empty if it
    had none), unchanged (since then), known (an earlier pass recorded it as the source's), beside, by_id. lanes(owner, target): the lane key of a path prefix.
    in-place, lane, by-id, or refused as lane-unresolved or lane-unmapped. On a live home, a session under no key of the source's home is the destination's own.
    """
    cached = F.col("cached_cwd")
    cwd = F.when(F.coalesce(cached != "", F.lit(False)), cached).when((cached == "") & F.col("unchanged"), F.lit(None)).otherwise(F.col("cwd"))
    x = candidates.withColumn("cwd", cwd)
    homed = (F.col("key") == home_key) | F.col("key").startswith(f"{home_key}-")
    x = x.withColumn("own", F.lit(live) & ~F.coalesce("known", F.lit(False)) & ~homed)
    found = owners(x.where("cwd is not null"), "cwd", lanes).select("session", F.col("target").alias("_lane"))
    x = x.join(found, "session", "left")
    at_key = F.coalesce(project_key(F.col("cwd")) == F.col("key"), F.lit(False))
    beside = F.coalesce("beside", F.lit(False)) & F.lit(live)
    lane = F.when(at_key | F.lit(live) | beside, F.col("_lane"))
    at_lane = F.coalesce(lane == F.col("key"), F.lit(False))
    own_key = at_key | beside & at_lane
    own = F.col("own")

    def out(outcome: str, reason: str | None = None, of: Column | None = None) -> Column:
        return F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).cast("string").alias("reason"), (F.lit(None).cast("string") if of is None else of).alias("lane"))

    verdict = (
        F.when(F.col("cwd").isNull(), F.when(own, out("in-place")).otherwise(out("refused", "lane-unresolved")))
        .when(F.lit(live) & at_lane, out("in-place", None, lane))
        .when(F.lit(live) & lane.isNull() & own_key & own, out("in-place"))
        .when(~own_key, F.when(own, out("in-place")).otherwise(out("refused", "lane-unresolved")))
        .when(lane.isNotNull(), out("lane", None, lane))
        .when(F.coalesce("by_id", F.lit(False)), out("by-id"))
        .otherwise(out("refused", "lane-unmapped"))
    )
    return x.withColumn("_v", verdict).select("session", "_v.outcome", "_v.reason", "cwd", "_v.lane")


def respelled(rows: DataFrame, links: DataFrame, undone: DataFrame) -> DataFrame:
    """(id, old, new) of rows(id, cwd) whose path is spelled through a link of links(link, real): the longest link first, rows of undone(id) excepted.

    A path that is not absolute, or has a part . or .. or an empty one behind the link, stays; so does one that would not change.
    """
    maps = links.select(F.col("link").alias("owner"), F.col("real").alias("target"))
    x = owners(rows.where("id is not null and cwd is not null").where(F.col("cwd").startswith("/")), "cwd", maps).where("owner is not null")
    rest = F.substring("cwd", F.length("owner") + 1, F.length("cwd"))
    odd = F.exists(F.split(F.regexp_replace(rest, "^/", ""), "/"), lambda p: p.isin(".", "..")) | rest.contains("//")
    new = mapped(F.col("cwd"), F.col("owner"), F.col("target"))
    x = x.where(~odd).select("id", F.col("cwd").alias("old"), new.alias("new")).where("old <> new")
    return x.join(undone.select("id").distinct(), "id", "left_anti")


def skipped(rows: DataFrame) -> DataFrame:
    """One row, skipped: rows(id, cwd) without a text for id or path."""
    return rows.agg(F.count_if(F.col("id").isNull() | F.col("cwd").isNull()).alias("skipped"))


def live_links(links: DataFrame, roots: DataFrame) -> DataFrame:
    """links(path, target) whose target is one of roots(root) or lies under one, by whole components."""
    keys = links.select("target").distinct()
    under = keys.withColumn("root", F.explode(ancestors(F.col("target")))).join(roots.select("root").distinct(), "root", "left_semi").select("target").distinct()
    return links.join(under, "target", "left_semi")


def corrected(base: DataFrame, dest: DataFrame, maps: DataFrame, files: DataFrame) -> DataFrame:
    """(id, disposition, rollout_path, cwd) for rows of base(id, rollout_path, cwd) whose paths map elsewhere by maps(owner, target).

    base-path-corrected where the mapped log is one of files(path) and no path has a part .., base-path-unavailable where not; state-changed where
    dest(id, rollout_path, cwd) no longer holds the base's paths.
    """
    x = base
    for c in ("rollout_path", "cwd"):
        got = owners(x.select("id", c).where(F.col(c).isNotNull()), c, maps)
        x = x.join(got.select("id", mapped(F.col(c), F.col("owner"), F.col("target")).alias(f"new_{c}")), "id", "left")
    x = x.where(~F.col("new_rollout_path").eqNullSafe(F.col("rollout_path")) | ~F.col("new_cwd").eqNullSafe(F.col("cwd")))
    x = x.join(dest.select(F.col("id").alias("_id"), F.col("rollout_path").alias("_r"), F.col("cwd").alias("_c")), F.col("id").eqNullSafe(F.col("_id")), "left")
    x = x.join(files.select(F.col("path").alias("new_rollout_path"), F.lit(True).alias("_there")).distinct(), "new_rollout_path", "left")
    sound = F.col("_there") & ~F.array_contains(F.split("new_rollout_path", "/"), "..") & ~F.array_contains(F.split("new_cwd", "/"), "..") & F.col("new_cwd").startswith("/")
    held = F.col("_r").eqNullSafe(F.col("rollout_path")) & F.col("_c").eqNullSafe(F.col("cwd"))
    word = F.when(~F.coalesce(sound, F.lit(False)), "base-path-unavailable").when(~held, "state-changed").otherwise("base-path-corrected")
    return x.select("id", word.alias("disposition"), F.when(word == "base-path-corrected", F.col("new_rollout_path")).otherwise(F.col("rollout_path")).alias("rollout_path"), F.when(word == "base-path-corrected", F.col("new_cwd")).otherwise(F.col("cwd")).alias("cwd"))


def repositories(entries: DataFrame) -> DataFrame:
    """(root, kind, nested_in) of the repositories among entries(path, kind): main where .git is a directory, linked where it is a file, bare where a directory holds HEAD, objects and
    refs by itself. nested_in is the nearest repository above, null without one; what lies inside a repository's own directory is none."""
    dir_, name = F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1), F.regexp_extract("path", "([^/]*)$", 1)
    x = entries.withColumns({"dir": dir_, "name": name})
    marked = x.where("name = '.git' and kind in ('directory', 'regular')").select(F.col("dir").alias("root"), F.when(F.col("kind") == "directory", "main").otherwise("linked").alias("kind"))
    own = x.where("(name = 'HEAD' and kind = 'regular') or (name in ('objects', 'refs') and kind = 'directory')").groupBy("dir").agg(F.count_distinct("name").alias("n"))
    bare = own.where("n = 3").where(~F.array_contains(F.split("dir", "/"), ".git")).select(F.col("dir").alias("root"), F.lit("bare").alias("kind"))
    every = marked.union(bare).groupBy("root").agg(F.max("kind").alias("kind"))
    above = every.select("root", F.explode(ancestors(F.col("root"))).alias("up")).where("up <> root").join(every.select(F.col("root").alias("up")), "up")
    return every.join(above.groupBy("root").agg(F.max_by("up", F.length("up")).alias("nested_in")), "root", "left").select("root", "kind", "nested_in")
