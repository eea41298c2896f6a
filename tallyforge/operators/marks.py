"""Kinds of names, texts and lines told by their marks: columns of built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shapes of tokens that are secrets.
SECRETS = ("ghp_", "gho_", "github_pat_", "AGE-SECRET-KEY-", "-----BEGIN", "sk-", "xoxb-", "Bearer ")
# What a child's error output says, the first class that has a phrase in it.
STDERR = {
    "no_space": ("no space left on device", "disk quota exceeded"),
    "timeout": ("timed out", "timeout, server", "connection timeout"),
    "host_unreachable": (
        "could not resolve hostname", "could not resolve host", "name or service not known", "nodename nor servname provided", "temporary failure in name resolution", "no route to host", "network is unreachable", "connection refused",
        "connection closed by remote host", "connection reset by peer",
    ),
    "auth_failed": (
        "permission denied (publickey", "permission denied, please try again", "authentication failed", "host key verification failed", "could not read username", "could not read password", "too many authentication failures",
        "no supported authentication methods",
    ),
    "not_a_repository": ("not a git repository", "does not appear to be a git repository", "repository not found", "fatal: cannot change to '", ": cd: "),
    "bad_object": ("bad object", "bad revision", "missing object", "object not found", "is corrupt", "unable to read", "invalid object", "did not receive expected object"),
}
#: Longest note and longest line that pass.
NOTE, LINE = 160, 200


def looks_secret(text: Column) -> Column:
    return reduce(lambda a, m: a | text.contains(m), SECRETS, F.lit(False))


def note(text: Column) -> Column:
    """A text as one line of printable ASCII, white space folded, cut behind NOTE characters; <redacted> where it holds a secret's shape."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\x21-\x7E]", " "), " +", " "))
    return F.when(looks_secret(text), "<redacted>").otherwise(F.when(F.length(flat) > NOTE, F.concat(F.substring(flat, 1, NOTE), F.lit("..."))).otherwise(flat))


def identifier_lines(text: Column, most: int = 256) -> Column:
    """The lines of a text reduced to the characters of identifiers, without empty, long and secret-shaped ones; the first `most`."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9._:/@=+,'()\[\]#*-]", " "), " +", " ")))
    return F.slice(F.filter(lines, lambda x: (x != "") & (F.length(x) <= LINE) & ~looks_secret(x)), 1, most)


def stderr_class(text: Column) -> Column:
    """The class of a child's error output; lines of a shell's warning about its locale do not count."""
    low = F.array_join(F.filter(F.split(F.lower(text), r"\r?\n"), lambda x: ~x.contains("setlocale")), "\n")
    out = None
    for name, phrases in STDERR.items():
        hit = reduce(lambda a, p: a | low.contains(p), phrases, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def temporary(name: Column, prefix: str) -> Column:
    """What a name of the grammar PREFIX[tag-[d-]]pid-serial is: file, directory or untagged; null for any other. Numbers have no leading zero and 64 bits."""
    number, tag = "(?:0|[1-9][0-9]{0,19})", "[0-9a-f]{16}"
    rest = F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 20))
    fits = F.forall(F.regexp_extract_all(F.regexp_replace(rest, f"^{tag}-(d-)?", ""), F.lit("([0-9]+)"), F.lit(1)), lambda n: F.try_to_number(n, F.lit("9" * 20)) <= F.lit("18446744073709551615").cast("decimal(20,0)"))
    kind = F.when(rest.rlike(f"^{tag}-d-{number}-{number}$"), "directory").when(rest.rlike(f"^{tag}-{number}-{number}$"), "file").when(rest.rlike(f"^{number}-{number}$"), "untagged")
    return F.when(fits, kind)


def temporary_tag(name: Column, prefix: str) -> Column:
    """The tag of a tagged temporary name."""
    return F.when(temporary(name, prefix).isin("file", "directory"), F.substring(name, len(prefix) + 1, 16))


def ref_storage(path: Column) -> Column:
    """Whether a file lies in a directory that holds refs or their logs."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin("refs", "logs"))


def looks_like_ref(head: Column) -> Column:
    """Whether a file's first bytes are a symbolic ref, a loose ref or a line of a ref's log."""
    return head.rlike("^(?:ref: |(?:[0-9a-f]{40}|[0-9a-f]{64})[\n ])")


def leading_timestamp(line: Column) -> Column:
    """The timestamp that a JSON line begins with, as it is written; null where it has an escape or comes later."""
    return F.nullif(F.regexp_extract(line, r'^\{"timestamp":"([^"\\]*)"', 1), F.lit(""))


def has_ordinal(line: Column) -> Column:
    """Whether the first 96 bytes of a line hold the name of an ordinal."""
    return F.substring(line, 1, 96).contains('"ordinal":')


def tagged_ids(line: Column) -> Column:
    """All turn and call ids of a JSON line, tagged t: or c:, without the made-up turn ids rollout-N."""
    body = r'":"((?:[^"\\]|\\.)*)"'
    turns = F.filter(F.regexp_extract_all(line, F.lit('"turn_id' + body), F.lit(1)), lambda x: ~x.rlike("^rollout-[0-9]+$"))
    calls = F.regexp_extract_all(line, F.lit('"call_id' + body), F.lit(1))
    return F.concat(F.transform(turns, lambda x: F.concat(F.lit("t:"), x)), F.transform(calls, lambda x: F.concat(F.lit("c:"), x)))


def is_percent(token: Column) -> Column:
    """Whether a text is a whole number from 0 to 100."""
    return F.coalesce(token.rlike(r"^\+?0*(?:[0-9]{1,2}|100)$"), F.lit(False))


def is_code_token(token: Column) -> Column:
    """Whether a text has the shape of a refusal's code."""
    return F.coalesce(token.rlike("^[A-Z][A-Z0-9_]{0,63}$"), F.lit(False))


def mounts(lines: DataFrame, column: str) -> DataFrame:
    """(device, root, point) of the lines of a mount table; octal escapes are undone."""
    p = F.split(column, " ")

    def plain(c: Column) -> Column:
        # the escapes that such a table has: space, tab, line feed, backslash
        return reduce(lambda a, e: F.replace(a, F.lit(e[0]), F.lit(e[1])), (("\\040", " "), ("\\011", "\t"), ("\\012", "\n"), ("\\134", "\\")), c)

    return lines.where(F.size(p) >= 5).select(p[2].alias("device"), plain(p[3]).alias("root"), plain(p[4]).alias("point"))


def entry_class(path: Column, kind: Column, sqlite: Column, history: str) -> Column:
    """The class of a manifest entry, the first rule that holds; kind is f for files, sqlite whether its head is a database's; history the one repository of its own class."""
    parts = F.split(path, "/")
    second, n = F.get(parts, F.lit(1)), F.size(parts)
    top, last = parts[0], F.element_at(parts, -1)
    in_git = (top == "git") & (n > 1)
    admin = (second == "mirrors") | F.exists(parts, lambda p: p.endswith(".git"))
    agent = F.exists(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), lambda k: (k <= n - 3) & (F.get(parts, k) == ".claude") & (F.get(parts, k + 1) == "worktrees"))
    return (
        F.when(in_git & (F.concat(F.lit("git/"), second) == history), "git-history").when(in_git & admin, "git-admin").when(in_git & (second.endswith(".worktrees") | agent), "git-worktree").when(top == "git", "git-checkout")
        .when((kind == "f") & (sqlite | last.endswith("-wal")), "sqlite")
        .when(top.isin(".codex", ".claude", ".claude.json"), "agents")
        .when((top == ".ssh") | ((top == ".config") & F.coalesce(second == "agent", F.lit(False))), "credentials")
        .when(F.array_contains(parts, "node_modules"), "node-modules").when(top == "projects", "projects").when(top == ".cache", "cache").when(top == "data", "large-data").when(top.startswith(".") | (top == "dotfiles"), "dotfiles").otherwise("edge")
    )


def move_action(workspace: Column, capture: Column, presence: Column, seats: Column) -> tuple[Column, Column]:
    """(action, reason) for an item: capture is held, refused, transient or pending, presence of its live path absent, empty, git, not-git, symlinked or unreadable."""
    held, free, there = capture == "held", presence.isin("absent", "empty"), presence.isin("git", "symlinked")
    rules = [
        (capture == "pending", "refuse", "capture-pending"), (capture == "transient", "refuse", "capture-transient"), (presence == "unreadable", "refuse", "unreadable"), ((presence == "symlinked") & ~(seats & held), "refuse", "symlinked-path"),
        (workspace & held & free, "land", "absent"), (workspace & held & there, "adopt", "adopt-or-beside"), (held & (presence == "not-git"), "refuse", "not-git"), (workspace & (capture == "refused"), "refuse", "capture-refused"),
        (held & free, "land", "bare-landing"), (held & there, "refs-only", "refs-only-adopt"), (capture == "refused", "refuse", "capture-refused-refs-only"),
    ]
    action = reason = F
    for of, a, r in rules:
        action, reason = action.when(of, a), reason.when(of, r)
    return action, reason


def escaped(content: Column) -> Column:
    """Bytes as text: printable ASCII as it is, a backslash and any other byte as \\xNN."""
    # a character for each byte; runs of plain and of other ones are taken apart, never single bytes
    text, plain = F.decode(content, "ISO-8859-1"), r"[\x20-\x5b\x5d-\x7e]"
    runs = F.regexp_extract_all(text, F.lit(f"{plain}+|[^{plain[1:-1]}]+"), F.lit(0))
    told = F.transform(runs, lambda r: F.when(r.rlike(f"^{plain}"), r).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(r, "ISO-8859-1"))), "(..)", r"\\x$1")))
    return F.when(text.rlike(f"[^{plain[1:-1]}]"), F.array_join(told, "")).otherwise(text)


def unescaped(text: Column) -> Column:
    """The bytes of an escaped text; a backslash that begins no \\xNN stands for itself."""
    runs = F.regexp_extract_all(text, F.lit(r"(?:\\x[0-9a-fA-F]{2})++|[^\\]+|\\"), F.lit(0))
    parts = F.transform(runs, lambda r: F.when(r.rlike(r"^\\x[0-9a-fA-F]{2}"), F.replace(r, F.lit("\\x"), F.lit(""))).otherwise(F.hex(F.encode(r, "UTF-8"))))
    return F.when(text.contains("\\"), F.unhex(F.array_join(parts, ""))).otherwise(F.encode(text, "UTF-8"))


def typed_refusals(rows: DataFrame, code: str, codes: DataFrame) -> DataFrame:
    """rows with typed and retired: whether the code names a cause that codes(code) hold, IO and FRAME_CODEC not counting, and whether it has left them."""
    x = rows.join(codes.select(F.col("code").alias(code), F.lit(True).alias("_known")).distinct(), code, "left")
    known = F.coalesce("_known", F.lit(False))
    return x.select(*rows.columns, (known & ~F.col(code).isin("IO", "FRAME_CODEC")).alias("typed"), (~known & F.col(code).isNotNull()).alias("retired"))
