"""Lines of listings as rows, sets of names and ids, digests over ordered rows, and roll-ups of measurements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEX = "^(?:[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$"


def refs_listed(lines: DataFrame, column: str) -> DataFrame:
    """(oid, name) of lines `oid name`."""
    p = F.split(column, " ", 2)
    return lines.select(p[0].alias("oid"), F.get(p, F.lit(1)).alias("name"))


def stash_listed(lines: DataFrame, column: str) -> DataFrame:
    """(oid, message, valid) of lines `oid NUL message`; empty lines are none, and a line of another form is not valid."""
    p = F.split(column, "\x00")
    valid = (F.size(p) == 2) & p[0].rlike(HEX)
    return lines.where(F.length(column) > 0).select(F.when(valid, p[0]).alias("oid"), F.when(valid, p[1]).alias("message"), valid.alias("valid"))


def nul_records(blobs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, record) of records that NULs end."""
    each = blobs.select(key, F.posexplode(F.split(F.regexp_replace(column, "\x00$", ""), "\x00", -1)).alias("pos", "record"))
    return each.where("record <> ''")


def worktrees(blobs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, path, head, branch, bare, detached, locked, prunable) of a listing of worktrees: NUL-ended fields, an empty one behind each worktree."""
    each = blobs.select(key, F.posexplode(F.filter(F.split(column, "\x00\x00"), lambda x: x != "")).alias("pos", "r"))
    fields = F.transform(F.split("r", "\x00"), lambda f: F.struct(F.substring_index(f, " ", 1).alias("k"), F.when(F.contains(f, F.lit(" ")), F.substring(f, F.instr(f, " ") + 1, F.length(f))).otherwise("").alias("v")))
    at = each.select(key, "pos", F.map_from_entries(F.filter(fields, lambda f: f["k"] != "")).alias("m"))
    flags = [F.map_contains_key("m", n).alias(n) for n in ("bare", "detached", "locked", "prunable")]
    return at.select(key, "pos", F.try_element_at("m", F.lit("worktree")).alias("path"), F.try_element_at("m", F.lit("HEAD")).alias("head"), F.try_element_at("m", F.lit("branch")).alias("branch"), *flags)


def in_directory_order(paths: DataFrame, path: str) -> DataFrame:
    """paths with dir and place: each entry's place in its directory by the bytes of its name, from 1. Names of a directory are one task's."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    x = paths.withColumn("dir", F.regexp_extract(path, "^(?:(.*)/)?[^/]*$", 1))
    return x.withColumn("place", F.row_number().over(W.partitionBy("dir").orderBy(name.cast("binary"))))


def joined_samples(lines: DataFrame, column: str, base: str, others: list[str], keys: list[str], fields: dict[str, list[str]]) -> DataFrame:
    """Samples of `base` lines with what other kinds of lines say of the same keys: lines are a kind and key=value words, fields name the values of each kind.

    A key that a line repeats has its last value, unknown is null; of several lines of a kind and key the last value by text counts.
    """
    def value(name: str) -> Column:
        # the last one of the line
        return F.when(F.col("_words").contains(f" {name}="), F.substring_index(F.substring_index("_words", f" {name}=", -1), " ", 1)).alias(name)

    spaced = reduce(lambda a, c: F.replace(a, F.lit(c), F.lit(" ")), "\t\n\x0b\f\r", F.concat(F.lit(" "), F.col(column)))
    words = lines.select(F.substring_index(column, " ", 1).alias("_kind"), spaced.alias("_words"))

    def read(kinds: list[str], names: list[str]) -> DataFrame:
        got = words.where(F.col("_kind").isin(*kinds)).select("_kind", *[value(n) for n in dict.fromkeys(names)])
        # through a generator: conditions on the values stay above it and do not take the line apart once more
        got = got.select(F.inline(F.array(F.struct(*got.columns))))
        return got.select("_kind", *[F.nullif(F.col(n), F.lit("unknown")).alias(n) for n in got.columns[1:]])

    out = read([base], [*keys, *fields[base]]).select(*keys, *fields[base])
    if not others:
        return out
    # all other kinds in one aggregate, so that samples are dealt out and joined once
    named = {f"_{i}_{f}": (kind, f) for i, kind in enumerate(others) for f in fields[kind]}
    said = read(others, [*keys, *[f for _, f in named.values()]]).groupBy(*keys).agg(*[F.max(F.when(F.col("_kind") == kind, F.col(f))).alias(n) for n, (kind, f) in named.items()])
    return out.join(said, keys, "left").select(*keys, *fields[base], *[F.col(n).alias(f) for n, (_, f) in named.items()])


def pruned(paths: DataFrame, path: str, excluded: DataFrame) -> DataFrame:
    """paths that neither are nor lie under a path of excluded(prefix); by whole components, through each path's ancestors."""
    from .paths import ancestors

    keys = paths.select(path).distinct()
    under = keys.withColumn("prefix", F.explode(ancestors(F.col(path)))).join(excluded.select("prefix").distinct(), "prefix", "left_semi").select(path).distinct()
    return paths.join(under, path, "left_anti")


def asides(names: DataFrame, tags: list[str], label: str) -> DataFrame:
    """(dir, name, aside): siblings of names(dir, name) called name.TAG-anything for one of the tags, or name.label."""
    parts = F.split("name", "\\.", -1)
    # a name with several dots may be an aside of several
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), ".").alias("name"), F.array_join(F.slice(parts, i + 1, F.size(parts)), ".").alias("suffix")))
    each = names.where(F.size(parts) > 1).select("dir", F.col("name").alias("aside"), F.explode(cuts).alias("c")).select("dir", "aside", "c.name", "c.suffix")
    fits = F.col("suffix") == label
    for tag in tags:
        fits |= F.col("suffix").startswith(f"{tag}-")
    return each.where(fits & (F.col("name") != "")).join(names.select("dir", "name").distinct(), ["dir", "name"]).select("dir", "name", "aside").distinct()


def elsewhere(files: DataFrame, others: DataFrame) -> DataFrame:
    """files(key, name) with held: a file of that name lies under another key of others(key, name)."""
    n = others.groupBy("name").agg(F.min("key").alias("_a"), F.max("key").alias("_b"))
    other = F.col("_a").isNotNull() & ((F.col("_a") != F.col("key")) | (F.col("_b") != F.col("key")))
    return files.join(n, "name", "left").select("key", "name", F.coalesce(other, F.lit(False)).alias("held"))


def holdings(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """wanted ids with state: have or lack."""
    h = held.select(key).distinct().withColumn("_h", F.lit(True))
    return wanted.select(key).distinct().join(h, key, "left").select(key, F.when(F.col("_h"), "have").otherwise("lack").alias("state"))


def expected(manifest: DataFrame, records: DataFrame, since: int) -> DataFrame:
    """manifest(name) with state: missing, stale (its record started before since) or there; records(name, started), the latest counts. A name listed twice is an error."""
    if not manifest.groupBy("name").count().where("count > 1").isEmpty():
        raise ValueError("the manifest lists a transfer twice")
    r = records.groupBy("name").agg(F.max("started").alias("started"))
    return manifest.join(r, "name", "left").select("name", F.when(F.col("started").isNull(), "missing").when(F.col("started") < since, "stale").otherwise("there").alias("state"))


def unmatched_reviews(reviews: DataFrame, refusals: DataFrame, codes: DataFrame) -> DataFrame:
    """Distinct (item, code, reason) of reviews(item, instance, code) that close nothing; item and instance are null for a policy.

    refusal-code-retired: the code is none of codes(code) any more; refusal-instance-stale: refusals(item, instance, code) hold that item and
    code, but of another instance; no-such-refusal: they do not hold it at all. A policy with a living code is never unmatched.
    """
    known = codes.select("code", F.lit(True).alias("_known")).distinct()
    exact = refusals.select("item", "instance", "code", F.lit(True).alias("_exact")).distinct()
    other = refusals.select("item", "code", F.lit(True).alias("_other")).distinct()
    x = reviews.join(known, "code", "left").join(exact, ["item", "instance", "code"], "left").join(other, ["item", "code"], "left")
    reason = F.when(F.col("_known").isNull(), "refusal-code-retired").when(F.col("item").isNull() | F.col("_exact"), None).when(F.col("_other"), "refusal-instance-stale").otherwise("no-such-refusal")
    return x.select("item", "code", reason.alias("reason")).where("reason is not null").distinct()


def _told(*parts: str) -> Column:
    """The parts as one text, each behind its length, null told from empty."""
    return F.concat(*[F.coalesce(F.concat(F.length(F.col(p).cast("string")).cast("string"), F.lit(":"), F.col(p).cast("string")), F.lit("~")) for p in parts])


def folded(rows: DataFrame, by: str, order: str, *parts: str) -> DataFrame:
    """(by, root): a digest of a group's rows in order; each part stands behind its length, a null part as ~. For groups as large as one manifest."""
    each = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), _told(*parts).alias("v"))))
    return rows.groupBy(by).agg(F.sha2(F.array_join(F.transform(each, lambda x: x["v"]), "").cast("binary"), 256).alias("root"))


def identity(rows: DataFrame, order: str, width: int, *parts: str) -> DataFrame:
    """One row, root: a digest of all rows in the order of a whole number from 0 up. Runs of `width` numbers are folded, then runs of `width`
    runs, until one is left: no task folds more than `width` of them. Without rows, the digest of nothing."""
    most = rows.agg(F.max(order)).first()[0] or 0
    runs = folded(rows.withColumn("_run", F.floor(F.col(order) / width)), "_run", order, order, *parts)
    while most >= width:
        most //= width
        runs = folded(runs.withColumn("_up", F.floor(F.col("_run") / width)), "_up", "_run", "_run", "root").withColumnRenamed("_up", "_run")
    return runs.agg(F.coalesce(F.max("root"), F.sha2(F.lit("").cast("binary"), 256)).alias("root"))


def item_digest(*parts: str) -> Column:
    """A digest of a record's parts, each behind its length, null told from empty."""
    one = [F.coalesce(F.concat(F.length(F.col(p).cast("string")).cast("string"), F.lit(":"), F.col(p).cast("string")), F.lit("~")) for p in parts]
    return F.sha2(F.concat_ws("|", *one).cast("binary"), 256)


def weighted_level(rows: DataFrame, by: list[str], level: str, n: str) -> DataFrame:
    """by..., level: the mean of levels weighed by their numbers of samples; null without samples."""
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.col(level) * F.col(n)), F.sum(F.when(F.col(level).isNotNull(), F.col(n)))).alias("level"))


def share_of(rows: DataFrame, by: list[str], part: str, whole: str) -> DataFrame:
    """by..., share: sum of part over sum of whole; null where that is 0."""
    return rows.groupBy(*by).agg(F.try_divide(F.sum(part).cast("double"), F.sum(whole).cast("double")).alias("share"))


def settled_blocks(rows: DataFrame, t: str, start: str, end: str, settle: int, width: int) -> DataFrame:
    """rows in [start + settle, end) with block, the number of their stretch of `width`."""
    at = F.col(t) - F.col(start) - settle
    return rows.where((at >= 0) & (F.col(t) < F.col(end))).withColumn("block", F.floor(at / width))


def halves(blocks: DataFrame, by: str, block: str) -> DataFrame:
    """blocks with half: early or late; the middle one of an odd number goes. A block occurs once in a group."""
    w = W.partitionBy(by)
    x = blocks.withColumn("_i", F.row_number().over(w.orderBy(block))).withColumn("_n", F.count("*").over(w))
    half = F.when(F.col("_i") <= F.floor(F.col("_n") / 2), "early").when(F.col("_i") > F.ceil(F.col("_n") / 2), "late")
    return x.withColumn("half", half).where("half is not null").drop("_i", "_n")


def back_filled(rows: DataFrame, missed: DataFrame, metrics: list[str]) -> DataFrame:
    """rows(window, metric, value) and, for each of missed(window, lag), a row of every metric with the lag as its value."""
    more = missed.select("window", F.explode(F.array(*map(F.lit, metrics))).alias("metric"), F.col("lag").alias("value"))
    return rows.select("window", "metric", "value").unionByName(more)


def bench_gate(samples: DataFrame, by: str, memory: int = 2 * 1024 * 1024) -> DataFrame:
    """by, initial_win, delta_win, warm_zero, interrupted_zero, memory_ok, verdict of samples(arm, phase, ms, transferred, source_read, rss_kib, gated).

    Our medians are below theirs in the phases initial and delta; our warm and our interrupted resumes moved and read exactly 0 bytes, which an
    unknown number is not; ours never took `memory` KiB. PASS if all hold, FAIL if not or if a median is missing, INFORMATIONAL where a sample is not gated.
    """
    ours = F.col("arm") == "ours"

    def win(phase: str) -> Column:
        a, b = (F.median(F.when((F.col("arm") == arm) & (F.col("phase") == phase), F.col("ms"))) for arm in ("ours", "theirs"))
        return F.coalesce(a < b, F.lit(False))

    def zero(phase: str) -> Column:
        nothing = F.coalesce((F.col("transferred") == 0) & (F.col("source_read") == 0), F.lit(False))
        return F.coalesce(F.every(F.when(ours & (F.col("phase") == phase), nothing)), F.lit(True))

    small = F.coalesce(F.every(F.when(ours, F.coalesce(F.col("rss_kib") < memory, F.lit(False)))), F.lit(True))
    out = samples.groupBy(by).agg(
        win("initial").alias("initial_win"), win("delta").alias("delta_win"), zero("warm-resume").alias("warm_zero"), zero("interrupted-resume").alias("interrupted_zero"), small.alias("memory_ok"), F.every("gated").alias("_gated")
    )
    passed = F.col("initial_win") & F.col("delta_win") & F.col("warm_zero") & F.col("interrupted_zero") & F.col("memory_ok")
    return out.withColumn("verdict", F.when(~F.col("_gated"), "INFORMATIONAL").when(passed, "PASS").otherwise("FAIL")).drop("_gated")


def one_percent(files: DataFrame, by: str, order: str, size: str) -> DataFrame:
    """files, with bytes: the first in order whose sizes add up to a hundredth of each group's, rounded up; the last is clipped.

    Sums of slices of the order come first, so that a group with most of the files is no task's alone. order is a whole number, distinct in a group.
    """
    some = files.where(F.col(size) > 0)
    low, high, n = some.agg(F.min(order), F.max(order), F.count("*")).first()
    width = max(1, (high - low + 1) * 4096 // n) if n else 1
    sliced = some.withColumn("_slice", F.floor((F.col(order) - F.lit(low or 0)) / width))
    held = sliced.groupBy(by, "_slice").agg(F.sum(size).alias("_held"))
    all_ = held.groupBy(by).agg(F.sum("_held").alias("_all"))
    ahead = W.partitionBy(by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    held = held.select(by, "_slice", F.coalesce(F.sum("_held").over(ahead), F.lit(0)).alias("_before")).join(all_, by)
    # only slices that begin below the limit are read on
    held = held.withColumn("_limit", F.ceil(F.col("_all") / 100)).where("_before < _limit")
    inside = W.partitionBy(by, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    x = sliced.join(held, [by, "_slice"]).withColumn("_left", F.col("_limit") - F.col("_before") - F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return x.where("_left > 0").withColumn("bytes", F.least("_left", F.col(size))).select(*files.columns, "bytes")


def payload_equal(a: DataFrame, b: DataFrame, key: str, kind: str, values: dict[str, list[str]]) -> DataFrame:
    """One row, equal: both sides have the same keys and kinds, and of each kind the columns that count for it are equal."""
    names = sorted({c for v in values.values() for c in v})
    x, y = (s.select(key, F.struct(kind, *names).alias(n)) for s, n in ((a, "x"), (b, "y")))
    same = F.when(F.lit(False), True)
    for k, columns in values.items():
        here = F.lit(True)
        for c in columns:
            here = here & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
        same = same.when(F.col(f"x.{kind}") == k, here)
    met = x.join(y, key, "full_outer").select((F.col(f"x.{kind}").eqNullSafe(F.col(f"y.{kind}")) & F.coalesce(same, F.lit(True)) & F.col("x").isNotNull() & F.col("y").isNotNull()).alias("same"))
    return met.agg(F.coalesce(F.every(F.coalesce("same", F.lit(False))), F.lit(True)).alias("equal"))


def omissions(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., entries, bytes, unknown: sums of what was left out, and how many items did not say how much."""
    return rows.groupBy(*by).agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("entries").isNull()).alias("unknown"))


def ids_missing(source: DataFrame, target: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, ids, missing): distinct ids that pattern's first group finds in a key's source texts, and how many its target lacks."""

    def ids(x: DataFrame) -> DataFrame:
        return x.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("_id")).distinct()

    t = ids(target).withColumn("_h", F.lit(True))
    return ids(source).join(t, [key, "_id"], "left").groupBy(key).agg(F.count("*").alias("ids"), F.count_if(F.col("_h").isNull()).alias("missing"))


def refs_united(source: DataFrame, held: DataFrame, ahead: DataFrame, label: str, checked_out: DataFrame | None = None) -> DataFrame:
    """(name, action, tracking): source refs(name, oid) into held ones; ahead(oid, ancestor) are the pairs that hold.

    The stash and remote-tracking refs of the source take no part. create; same; forward, or switch where the branch is in checked_out(name, clean) and clean;
    kept where the held one is ahead. One that diverged, or is checked out with changes, is tracked: under its name in the source's namespace `label`.
    """
    from .checks import tracking_name

    refs = source.where(~((F.col("name") == "refs/stash") | F.col("name").startswith("refs/remotes/")))
    x = refs.select("name", F.col("oid").alias("s")).join(held.select("name", F.col("oid").alias("d")), "name", "left")
    a = ahead.distinct()
    x = x.join(a.select(F.col("oid").alias("s"), F.col("ancestor").alias("d"), F.lit(True).alias("_f")), ["s", "d"], "left")
    x = x.join(a.select(F.col("oid").alias("d"), F.col("ancestor").alias("s"), F.lit(True).alias("_b")), ["s", "d"], "left")
    x = x.withColumn("_clean", F.lit(None).cast("boolean")) if checked_out is None else x.join(checked_out.groupBy("name").agg(F.every("clean").alias("_clean")), "name", "left")
    forward = F.when(F.col("_clean").isNull(), "forward").when(F.col("_clean"), "switch").otherwise("track")
    action = F.when(F.col("d").isNull(), "create").when(F.col("s") == F.col("d"), "same").when(F.col("_f"), forward).when(F.col("_b"), "kept").otherwise("track")
    return x.withColumn("action", action).select("name", "action", F.when(F.col("action") == "track", tracking_name(F.col("name"), label)).alias("tracking"))


def projected(rows: DataFrame, target: list[str], path: str) -> DataFrame:
    """rows in the target's columns with supported: no target column is missing and the path is absolute without `..` parts."""
    lacking = [c for c in target if c not in rows.columns]
    fine = F.lit(not lacking) & F.col(path).startswith("/") & ~F.array_contains(F.split(path, "/"), "..") if path in rows.columns else F.lit(False)
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in target], F.coalesce(fine, F.lit(False)).alias("supported"))
