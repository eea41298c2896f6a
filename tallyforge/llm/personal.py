"""Operator 3: personal data by candidate gradient boosting, in built-in functions only.

Generators with high recall propose spans of four kinds, overlapping ones too: what the strict rules
match, and what they cannot reach, such as "name (at) site dot org", addresses with spaces round their dots, cards
with dots, slashes or double spaces, telephone numbers without a plus, values cut by a line's end. Boosted trees of
depth two, grown by grouped sums over all labelled candidates, weigh features of a
span's format and surroundings. They learn from labels of several origins: rules that a value passes or fails, and
words that introduce a span ("phone:", "order no."), which are themselves no features. Candidates that pass the strict
rules are always redacted; of the others, those whose probability reaches their kind's threshold, which a fold of
documents that the trees have not seen sets where the precision of spans beyond the strict rules suffices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rows import keyed, restored
from .scratch import saved

KINDS = ("email", "ip", "card", "phone")

# The format rules. Quantifiers are possessive where what follows can never start inside
# them, and a match may not start inside a run that has just failed as a whole; neither changes a match.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What is proposed besides.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\s?(?:\(at\)|\[at\]|\{at\}|@)\s?|\x20at\x20(?=[A-Za-z0-9-]{1,63}+\x20?(?:\(dot\)|\[dot\]|dot\x20)))[A-Za-z0-9-]{1,63}+(?:(?:\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\x20dot\x20|\.\s?)[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\s?(?:\.|\[\.\]|\(dot\))\s?[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\s./_-]{1,2}(?:[0-9]{4}[\s./_-]{1,2}[0-9]{4}(?:[\s./_-]{1,2}[0-9]{1,7})?|[0-9]{6}[\s./_-]{1,2}[0-9]{5}))(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\s./-]{1,2}[0-9]{2,5}){1,4}(?![0-9])",
}
# Words that introduce each kind, and words that introduce numbers and names of other sorts.
CUE = {
    "email": r"(?i)\b(e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(ip|host|server|gateway|address)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|payment)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax|cell)\b",
}
OTHER = r"(?i)\b(order|invoice|isbn|ref|version|ver|release|build|page|pages|date|section|article|serial|sku|part|ticket|score|room|id|no|meet|look|arrive)\b"
# What a text speaks of, near a span.
TOPIC = r"(?i)\b(reach|reply|send|customer|name|office|home|support|login|connect|ping|billing|pay|charge|expires|call me|ask|for|at|to)\b"
OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"


# Without these a text has no span of the kind.
SIGN = {"email": r"@|\(at\)|\[at\]|\{at\}| at [A-Za-z0-9-]+ ?[(\[]?dot", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, strict, start, end, what, before, after): every proposed span.

    kind is a place in KINDS; start and end count code points, end exclusive; before and after are
    the characters next to the span, back to the match before and on to the next one.
    """
    text = F.coalesce("text", F.lit(""))

    def found(kind: str, pattern: str, strict: bool) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.struct(F.length(x).alias("n"), F.right(x, F.lit(24)).alias("tail"), F.left(x, F.lit(8)).alias("head")))
        what = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        got = F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(strict).alias("strict"), gaps.alias("gaps"), what.alias("what"))
        return F.when(text.rlike(SIGN[kind]), got)

    every = F.array(*[found(k, p[k], p is STRICT) for p in (STRICT, LOOSE) for k in KINDS])
    each = docs.select("doc_id", F.explode(every).alias("c")).where(F.size("c.what") > 0).select("doc_id", "c.*")
    n = F.size("what")
    rows = each.select(
        "doc_id", "kind", "strict",
        F.posexplode(F.arrays_zip(F.slice("gaps", 1, n).alias("a"), F.col("what").alias("w"), F.slice("gaps", 2, n).alias("b"))).alias("i", "m"),
    )
    end = F.sum(F.col("m.a.n") + F.length("m.w")).over(W.partitionBy("doc_id", "kind", "strict").orderBy("i"))
    return rows.withColumn("end", end.cast("int")).select(
        "doc_id", "kind", "strict", (F.col("end") - F.length("m.w")).alias("start"), "end", F.col("m.w").alias("what"), F.col("m.a.tail").alias("before"), F.col("m.b.head").alias("after")
    )


def digits() -> Column:
    return F.regexp_replace("what", "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(x: Column, i: Column) -> Column:
        d = x.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    one = F.transform(F.filter(F.split(F.reverse(number), ""), lambda x: x != ""), value)
    return F.aggregate(one, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes() -> Column:
    """Whether a match of a strict pattern is a base span."""
    n = F.length(digits())
    kind = F.col("kind")
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, F.forall(F.split("what", r"\."), lambda x: x.rlike(OCTET)))
        .when(kind == 2, F.when(n.between(12, 19), luhn(digits())).otherwise(F.lit(False)))
        .otherwise(n.between(9, 15))
    )


#: A feature has whole values from 0 to LEVELS - 1.
LEVELS = 24


def features() -> list[Column]:
    """Format and surroundings of a span, without the words that label it."""
    d, c = F.length(digits()), F.length("what")
    octets = F.forall(F.filter(F.split("what", "[^0-9]+"), lambda x: x != ""), lambda x: x.rlike(OCTET))
    some = [
        F.col("kind"), d, c, c - d, F.regexp_count("what", F.lit(r"[\s().-]")), F.col("what").startswith("+").cast("int"), F.col("what").contains("(").cast("int"),
        F.col("before").rlike(r"[A-Za-z0-9]$").cast("int"), F.col("after").rlike("^[A-Za-z0-9]").cast("int"), F.size(F.split("what", "[^0-9]+")),
        F.when(d.between(12, 19), luhn(digits())).otherwise(False).cast("int"), F.length(F.regexp_extract("what", r"([A-Za-z]*)$", 1)),
        octets.cast("int"), F.regexp_count("what", F.lit(r"\b(at|dot)\b|@")), F.col("what").contains("\n").cast("int"), F.col("before").rlike(r"[:=]\s*$").cast("int"),
        F.col("before").rlike(TOPIC).cast("int"), F.length(F.regexp_extract("what", r"^([0-9]*)", 1)), F.length(F.regexp_extract("what", r"([0-9]*)$", 1)), F.col("what").startswith("0").cast("int"),
    ]
    return [F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), x)).cast("int") for x in some]


def introduced() -> Column:
    """1 if a word of its kind introduces a span, 0 if one of another sort does, null with neither or both."""
    own = reduce(lambda a, k: a.when(F.col("kind") == KINDS.index(k), F.col("before").rlike(CUE[k])), KINDS[1:], F.when(F.col("kind") == 0, F.col("before").rlike(CUE["email"])))
    other = F.col("before").rlike(OTHER)
    return F.when(own & ~other, 1).when(other & ~own, 0)


Leaf = tuple[int, int, float, float]  # feature, cut, value at most the cut, value above


Tree = tuple[int, int, Leaf, Leaf]


def _of_kind(made: dict[int, Column], other: Column) -> Column:
    return reduce(lambda a, k: a.when(F.col("kind") == k, made[k]), made, F.when(F.lit(False), other)).otherwise(other)


def _tree_value(tree: dict[int, Tree]) -> Column:
    x = F.col("x")

    def leaf(b: Leaf) -> Column:
        return F.when(x[b[0]] <= b[1], F.lit(b[2])).otherwise(F.lit(b[3]))

    return _of_kind({k: F.when(x[f] <= cut, leaf(low)).otherwise(leaf(high)) for k, (f, cut, low, high) in tree.items()}, F.lit(0.0))


def _best(rows: list, n: int, rate: float = 0.5, pull: float = 1.0) -> Leaf:
    """The split with the greatest gain, from sums (f, v, g, h) of gradients."""
    table = [[(0.0, 0.0)] * LEVELS for _ in range(n)]
    for r in rows:
        table[r["f"]][r["v"]] = (r["g"], r["h"])
    best, out = -1.0, (0, LEVELS, 0.0, 0.0)
    for f, levels in enumerate(table):
        all_g, all_h = sum(g for g, _ in levels), sum(h for _, h in levels)
        g = h = 0.0
        for v, (dg, dh) in enumerate(levels):
            g, h = g + dg, h + dh
            gain = g * g / (h + pull) + (all_g - g) ** 2 / (all_h - h + pull)
            if gain > best + 1e-9:
                best, out = gain, (f, v, rate * g / (h + pull), rate * (all_g - g) / (all_h - h + pull))
    return out


def _counted(rows: DataFrame) -> DataFrame:
    return rows if "n" in rows.columns else rows.withColumn("n", F.lit(1))


def boost(sample: DataFrame, rounds: int = 8) -> list[dict[int, Tree]]:
    """Rounds of trees of depth two, one for each kind, on sample(kind, x: array of features, y: 0 or 1), for the logistic loss.

    Where sample has n, a row stands for n candidates. A level of a round takes one grouped sum by kind, side, feature and value: a bounded table.
    """
    sample, n = _counted(sample), len(sample.first()["x"])
    trees: list[dict[int, Tree]] = []
    for _ in range(rounds):
        z = reduce(lambda a, b: a + b, map(_tree_value, trees), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        now = sample.select("kind", "x", (F.col("n") * (F.col("y") - p)).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))

        def sums(side: Column, now: DataFrame = now) -> dict[tuple[int, int], list]:
            each = now.select("kind", side.alias("side"), "g", "h", F.posexplode("x").alias("f", "v"))
            out: dict[tuple[int, int], list] = {}
            for r in each.groupBy("kind", "side", "f", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                out.setdefault((r["kind"], r["side"]), []).append(r)
            return out

        roots = {kind: _best(rows, n)[:2] for (kind, _), rows in sums(F.lit(0)).items()}
        sides = sums(_of_kind({k: F.when(F.col("x")[f] <= cut, 0).otherwise(1) for k, (f, cut) in roots.items()}, F.lit(0)))
        trees.append({k: (f, cut, _best(sides.get((k, 0), []), n), _best(sides.get((k, 1), []), n)) for k, (f, cut) in roots.items()})
    return trees


def probability(trees: list) -> Column:
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, map(_tree_value, trees), F.lit(0.0))))


def thresholds(fold: DataFrame, trees: list, precision: float) -> dict[int, tuple[float, int, int]]:
    """For each kind: the lowest probability from which on (right + 1) / (all + 2) of the fold's spans reaches precision, with right and all.

    Where fold has n, a row stands for n spans. A kind without enough evidence for that has none, whatever the size of the table.
    """
    bins = _counted(fold).groupBy("kind", F.floor(probability(trees) * 50).alias("b")).agg(F.sum(F.col("y") * F.col("n")).alias("pos"), F.sum("n").alias("n")).collect()
    out = {}
    for kind in range(len(KINDS)):
        pos = n = 0
        for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["b"]):
            pos, n = pos + r["pos"], n + r["n"]
            if pos + 1 >= precision * (n + 2):
                out[kind] = (r["b"] / 50, pos, n)
    return out


def weighed(found: DataFrame) -> DataFrame:
    """candidates() with base, any (touches a base span), y (1 right, 0 wrong, null not known), loose and x (features).

    Right: touches a base span of its kind, or is introduced by a word of its kind. Wrong: touches a base span of
    another kind, or is introduced as something else, or lies within a strict match that failed.
    """
    row = found.withColumn("base", F.col("strict") & passes())

    def touches(which: Column, *by: str) -> Column:
        w = W.partitionBy("doc_id", *by).orderBy("start")
        ahead = F.max(F.when(which, F.col("end"))).over(w.rangeBetween(W.unboundedPreceding, -1))
        later = F.min(F.when(which, F.col("start"))).over(w.rangeBetween(0, W.unboundedFollowing))
        return F.coalesce(ahead > F.col("start"), F.lit(False)) | F.coalesce(later < F.col("end"), F.lit(False))

    row = row.withColumns(
        {
            "own": touches(F.col("base"), "kind"),
            "failed": F.coalesce(F.max(F.when(F.col("strict") & ~F.col("base"), F.col("end"))).over(W.partitionBy("doc_id", "kind").orderBy("start").rangeBetween(W.unboundedPreceding, 0)) >= F.col("end"), F.lit(False)),
            "any": touches(F.col("base")),
        }
    )
    y = F.when(F.col("own"), 1).when(F.col("any"), 0).when(F.col("failed"), 0).otherwise(introduced())
    return row.withColumn("y", y).withColumn("loose", ~F.col("strict") & ~F.col("any")).withColumn("x", F.array(*features()))


def learned(row: DataFrame, a_task: int = 10_000, precision: float = 0.95) -> tuple[list, dict[int, tuple[float, int, int]]]:
    """(trees, thresholds()) from all weighed() candidates with a label.

    Documents whose hash ends in 0 modulo 3 set the thresholds, on spans beyond the strict rules; the trees learn from the others. Candidates
    of equal features count as one row with their number, and a_task of these rows are dealt out to a task; results do not depend on it.
    """
    known = row.where("y is not null and (any or not strict)").withColumn("sets", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    known = saved(known.where("not sets or loose").groupBy("kind", "x", "y", "sets").agg(F.count("*").alias("n")), "labelled")
    tasks = known.count() // a_task + 1
    known = known if tasks == 1 else saved(known.repartition(tasks, "kind", "x"), "labelled")
    fit = known.where("not sets")
    if {r["y"] for r in fit.select("y").distinct().collect()} != {0, 1}:
        return [], {}
    trees = boost(fit)
    return trees, thresholds(known.where("sets"), trees, precision)


def personal_data(docs: DataFrame, a_task: int = 10_000, precision: float = 0.95) -> DataFrame:
    """Spans of personal data: doc_id, spans (array of start, kind, end, base) for every row, in order.

    docs: doc_id (null and repeated ids are rows of their own), text; other columns are ignored. base marks spans that the
    strict rules find. Added spans overlap none of these. A null or empty text has no
    span; an empty table gives no rows. Base spans never depend on the trees. The trees learn from all labelled
    candidates of two thirds of the documents and thresholds are set on those of the others; without right and wrong ones, or for a
    kind whose spans beyond the strict rules no threshold makes precise enough, nothing is added. A text of any
    length is matched whole, by one task.
    """
    docs, ids = keyed(docs.select("doc_id", "text"))
    row = saved(weighed(saved(candidates(docs), "candidates")), "weighed")
    kept = row.where("base").select("doc_id", "start", "kind", "end", "base")
    trees, limit = learned(row, a_task, precision)
    if limit:
        least_p = reduce(lambda a, k: a.when(F.col("kind") == k, F.lit(limit[k][0])), limit, F.when(F.lit(False), 2.0)).otherwise(2.0)
        more = row.where("loose").where(probability(trees) >= least_p).select("doc_id", "start", "kind", "end", "base").distinct()
        kept = kept.union(more)
    per = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean>>")
    return restored(docs.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.coalesce("spans", none).alias("spans")), ids)


def masked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with each span of found(doc_id, spans) replaced by its kind in brackets; of overlapping spans the first counts."""
    names = F.array(*map(F.lit, KINDS))
    done = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]")))).alias("out")),
        ).otherwise(a),
    )
    text = F.concat(F.array_join(done["out"], ""), F.substring(F.col("text"), done["at"] + 1, F.length("text")))
    return docs.join(found, "doc_id").withColumn("text", text).select(*docs.columns)
