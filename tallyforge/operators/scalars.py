"""Classes of names and codes, number and date tokens, decisions by small tables: columns of built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Refusals that only a rerun settles, and what they mean.
RERUN = {"GIT_CONVERGE_INTERRUPTED": "converge-interrupted", "TRANSPORT_LOST": "transport-lost", "MOVE_STATE_BUSY": "state-busy", "ITEMS_REFUSED": "run-level-refusal"}
# Refusals of a capture that may pass by themselves.
TRANSIENT = ("CAPTURE_DRIFTED", "GIT_AUTHORITY_CHANGED", "DESTINATION_SPACE_INSUFFICIENT", "SPACE_EXHAUSTED", "BUDGET_EXCEEDED", "WORKER_LOST", "IO")


def git_class(below: Column) -> Column:
    """The class of a path inside a repository's own directory, from its parts there."""
    parts = F.split(below, "/")
    n = F.size(parts)
    pack = (n >= 3) & (parts[0] == "objects") & (F.get(parts, F.lit(1)) == "pack")
    loose = (n == 3) & (parts[0] == "objects") & (F.length(F.get(parts, F.lit(1))) == 2)
    return F.when(pack, F.when(F.get(parts, F.lit(2)).endswith(".pack"), "git-pack").otherwise("git-pack-index")).when(loose, "git-loose").otherwise("git-admin")


def by_uuid(path: Column) -> Column:
    """Whether lines of the log at path are known by their uuid: a transcript below projects/."""
    return path.startswith("projects/") | path.rlike(r"(^|/)\.claude/projects/")


def rerun_only(code: Column) -> Column:
    """The reason of a refusal that no review closes, null for others."""
    return reduce(lambda a, k: a.when(code == k, RERUN[k]), RERUN, F.when(F.lit(False), F.lit(None).cast("string")))


def capture_state(held: Column, refusal: Column) -> Column:
    """held, transient, refused or pending."""
    return F.when(held, "held").when(refusal.isin(*TRANSIENT) | refusal.startswith("IO"), "transient").when(refusal.isNotNull(), "refused").otherwise("pending")


def lane_verdict(sessions_hold: Column, git: Column, handoff: Column) -> Column:
    """Whether a lane is done: its sessions hold, its repository is identical or waived, and it is handed over."""
    return F.coalesce(sessions_hold & git.isin("identical", "waived") & handoff, F.lit(False))


def integer_token(token: Column) -> Column:
    """The value of 12, -1_000, 0x1f, 0o17 or 0b11 as decimal(38,0), of any number of digits; null for anything else.

    A value beyond 38 decimal digits, or beyond 127 bits, is null.
    """
    bare = F.replace(token, F.lit("_"), F.lit(""))
    body = F.regexp_replace(bare, "^[+-]", "")
    whole = "decimal(38,0)"

    def based(prefix: str, digits: str, base: int) -> Column:
        # parts of up to 32 bits, each below what conv reads
        bits = {16: 4, 8: 3, 2: 1}[base]
        each = F.regexp_replace(F.substring(body, 3, 1 << 20), "^0+", "")
        step = 32 // bits
        padded = F.lpad(each, F.ceil(F.length(each) / step) * step, "0")
        parts = F.transform(F.sequence(F.lit(0), F.length(padded) - step, F.lit(step)), lambda i: F.conv(F.substring(padded, i + 1, F.lit(step)), base, 10).cast(whole))
        value = F.aggregate(parts, F.lit(0).cast(whole), lambda a, d: F.try_add(F.try_multiply(a, F.lit(1 << (bits * step)).cast("decimal(10,0)")).cast(whole), d).cast(whole))
        least = -(-127 // bits)
        return F.when(body.rlike(f"^{prefix}{digits}+$"), F.when(F.length(each) == 0, F.lit(0).cast(whole)).when(F.length(each) <= least, value))

    decimal = F.regexp_replace(body, "^0+(?=[0-9])", "")
    value = F.coalesce(based("0x", "[0-9A-Fa-f]", 16), based("0o", "[0-7]", 8), based("0b", "[01]", 2), F.when(decimal.rlike("^[0-9]{1,38}$"), decimal.try_cast(whole)))
    # by its text: negating a decimal would round it to 34 digits
    return F.when(bare.startswith("-"), F.concat(F.lit("-"), value.cast("string")).cast(whole)).otherwise(value)


def float_token(token: Column) -> Column:
    """The value of a number token as double, inf and nan too; null for anything else."""
    bare = F.replace(token, F.lit("_"), F.lit(""))
    body = F.regexp_replace(bare, "^[+-]+", "")
    plain = F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double"))
    inf = F.when(bare.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(body == "inf", inf).when(body == "nan", F.lit(float("nan"))).otherwise(F.coalesce(integer_token(token).cast("double"), plain))


def datetime_key(token: Column) -> Column:
    """A date and time with its separator as T and its zone letter as Z."""
    return F.replace(F.regexp_replace(token, "^(.{10})[t ]", "$1T"), F.lit("z"), F.lit("Z"))


def is_date(token: Column) -> Column:
    """Whether the text is a day YYYY-MM-DD of the calendar."""
    return F.coalesce(token.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(token, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_hex64(token: Column) -> Column:
    return F.coalesce(token.rlike("^[0-9a-f]{64}$"), F.lit(False))


def uuid_in_name(name: Column) -> Column:
    """The last 36 characters of a log's stem, where they have a uuid's shape; null elsewhere."""
    return F.nullif(F.regexp_extract(name, r"([0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12})\.jsonl(?:\.zst|\.gz)?$", 1), F.lit(""))


def rewritten(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """text with each whole path prefix replaced, the longest first; a path goes on with letters, digits and ._~+-."""
    longest = sorted(pairs, key=lambda p: (-len(p[0]), p[0]))
    byte = r"[A-Za-z0-9._~+/-]"
    quoted = [(r"\Q" + a + r"\E", b) for a, b in longest]
    # one pass: what a replacement brings in is not replaced again
    ends = rf"(?=$|/|(?!{byte}))"
    found = F.lit("(?<!" + byte + ")(?:" + "|".join(q for q, _ in quoted) + ")" + ends)
    gaps, hits = F.split(text, found, F.lit(-1)), F.regexp_extract_all(text, found, F.lit(0))
    to = F.create_map(*[F.lit(x) for p in longest for x in p])
    new = F.concat(F.transform(hits, lambda h: F.element_at(to, h)), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, new, lambda g, n: F.concat(g, n)), "")


def file_merge(base: Column, ours: Column, theirs: Column) -> Column:
    """same, land, merge or conflict for three digests of a file, null where a side lacks it; both changed is conflict."""
    return F.when(theirs.isNull(), "same").when(ours.isNull(), "land").when(ours == theirs, "same").when(base.isNull(), "conflict").when(base == ours, "merge").when(base == theirs, "same").otherwise("conflict")


def refusal_bucket(code: Column, is_store: Column, changed: Column, routed: tuple[str, ...], blocked: tuple[str, ...]) -> Column:
    """routed, blocked or other, by a refusal's first word."""
    word = F.split(code, " ")[0]
    return F.when(word.isin(*routed) & is_store, "routed").when(word.isin(*blocked) & changed, "blocked").otherwise("other")


def extension_candidate(length: Column, size: Column, links: Column, settled: Column) -> Column:
    """Whether what is held may be the beginning of a grown file: some but not all of it, one link, not racy."""
    return F.coalesce((length > 0) & (length < size) & (links == 1) & settled, F.lit(False))
