import random
import re
from collections import Counter

from helpers import corpus, docs_of, prose

from tallyforge.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for k, (name, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=d: 12 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=d: 9 <= len(d) <= 15,
            }[name]():
                out.append((m.start(), k, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(8)
    bits = ["a@b.c", "x.y%z+1@mail8.example.com", "@", "a@b", "%d@e.f", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "0255.0.1.2", "4111 1111 1111 1111", "4111111111111112",
            "4041894974608795", "+1 (386) 555-3733", "+49 30 123456", "(386) 555-3733", "+1", "+12-", "bob (at) site (dot) org", "é\U0001f600", "12-34", " ", " ", ".", ",", "tel", "card", "phone ", "\n"]
    out = corpus(5)[:60] + ["".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    out += ["7" * 30000, "a." * 20000 + "@x", "a@" + "b." * 20000 + "c", "1 " * 20000, "+" + "1" * 20000, "x" * 50000 + "@y.z"]
    return out


def test_base_spans_equal_brute_force_and_added_ones_keep_clear(spark):
    t = texts()
    rows = personal.personal_data(docs_of(spark, t)).collect()
    assert len(rows) == len(t)
    for r in rows:
        want = base(t[r.doc_id])
        assert [(s.start, s.kind, s.end) for s in r.spans if s.base] == want, repr(t[r.doc_id])[:300]
        for s in r.spans:
            assert s.base or all(s.end <= a or b <= s.start for a, _, b in want)
    # clean documents stay as they are
    assert all(not r.spans for r in rows if not re.search(r"[0-9@]|\(at\)", t[r.doc_id] or ""))


def planted(n=1500):
    """Texts with spans beyond the strict rules, and look-alikes: (text, right spans (start, end, kind), whether a word introduces it)."""
    rng = random.Random(21)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        head = "4" + digits(14)
        return head + next(c for c in "0123456789" if luhn(head + c))

    def no_card():
        d = digits(16)
        return d if not luhn(d) else no_card()

    def cut(d, sep):
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    right = {
        "email": (["mail ", "contact "], lambda: f"{prose(rng, 1)} {rng.choice(['(at)', '[at]', 'at'])} site{rng.randrange(99)} dot {rng.choice(['org', 'com', 'net'])}"),
        "card": (["card ", "visa "], lambda: cut(card(), rng.choice([".", "/", "  ", "_"]))),
        "phone": (["phone ", "tel "], lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{digits(4)}"),
        "ip": (["host ", "server "], lambda: rng.choice([" . ", "[.]"]).join(str(rng.randrange(1, 255)) for _ in range(4))),
    }
    wrong = {
        "email": (["meet ", "look "], lambda: f"{prose(rng, 1)} at {rng.randrange(99)} dot {rng.randrange(99)}"),
        "card": (["order ", "serial "], lambda: cut(no_card(), rng.choice([".", "/"]))),
        "phone": (["page ", "part "], lambda: f"{rng.randrange(10, 99)}.{rng.randrange(10, 99)}"),
        "ip": (["version ", "release "], lambda: " . ".join(str(rng.randrange(300, 999)) for _ in range(4))),
    }
    out = []
    for i in range(n):
        kind, good, told = personal.KINDS[i % 4], rng.random() < 0.6, rng.random() < 0.7
        cues, make = (right if good else wrong)[kind]
        text = f"{prose(rng, 6)} " + (rng.choice(cues) if told else "zz ")
        span = make()
        out.append((f"{text}{span} {prose(rng, 5)}", (len(text), len(text) + len(span), kind) if good else None, told))
    out += [(f"{prose(rng, 4)} a{i}@b{i}.org {prose(rng, 3)} 10.1.2.{i} +1 (212) 555-{1000 + i} {cut(card(), ' ')} {prose(rng, 3)}", None, True) for i in range(60)]
    return out


def test_added_spans_of_a_planted_table(spark):
    rows = planted()
    docs = docs_of(spark, [t for t, *_ in rows])
    weighed = personal.weighed(personal.candidates(docs)).cache()
    assert {r.kind for r in weighed.where("not strict and not any and y is null").select("kind").distinct().collect()} == {0, 1, 2, 3}, "open candidates of each kind"
    trees, limit = personal.learned(weighed, 10_000, 0.95)
    assert set(limit) == {0, 1, 2, 3} and all(pos + 1 >= 0.95 * (n + 2) for _, pos, n in limit.values())
    got = {r.doc_id: r.spans for r in personal.personal_data(docs).collect()}
    hit, all_right, added, fine, per = 0, 0, 0, 0, Counter()
    for i, (text, span, told) in enumerate(rows):
        assert [(s.start, s.kind, s.end) for s in got[i] if s.base] == base(text)
        more = [(s.start, s.end, personal.KINDS[s.kind]) for s in got[i] if not s.base]
        if told:
            continue  # words near these labelled the sample; the others show what was learned
        all_right += span is not None
        hit += span is not None and any(a < span[1] and span[0] < b and k == span[2] for a, b, k in more)
        added += len(more)
        fine += sum(span is not None and a < span[1] and span[0] < b and k == span[2] for a, b, k in more)
        per.update(k for *_, k in more)
    print(f"recall {hit}/{all_right}, precision {fine}/{added}", per)
    assert hit >= 0.8 * all_right and fine >= 0.9 * added and set(per) == set(personal.KINDS)


def test_boosting_learns_a_rule(spark):
    rng = random.Random(2)
    rows = [[rng.randrange(24) for _ in range(4)] for _ in range(600)]
    sample = spark.createDataFrame([(0, x, int(x[1] > 9 and x[3] < 15)) for x in rows], "kind int, x array<int>, y int")
    trees = personal.boost(sample, rounds=6)
    got = sample.select("y", personal.probability(trees).alias("p")).collect()
    assert sum((r.p > 0.5) == bool(r.y) for r in got) > 590
    limit, pos, n = personal.thresholds(sample, trees, 0.95)[0]
    assert 0 < limit < 1 and pos + 1 >= 0.95 * (n + 2)
    assert personal.thresholds(sample.limit(5), trees, 0.95) == {}


def test_masks(spark):
    df = docs_of(spark, ["write a@b.c or +1 (386) 555-3733 now", None])
    got = {r.doc_id: r.text for r in personal.masked(df, personal.personal_data(df)).collect()}
    assert got == {0: "write [email] or [phone] now", 1: None}


def test_empty_table(spark):
    assert personal.personal_data(docs_of(spark, ["a"]).limit(0)).collect() == []


def test_trees_and_thresholds_take_every_labelled_candidate(spark):
    from pyspark.sql import functions as F

    docs = docs_of(spark, [t for t, *_ in planted(900)])
    weighed = personal.weighed(personal.candidates(docs)).cache()
    whole, dealt = (personal.learned(weighed, n, 0.95)[1] for n in (10**9, 40))
    assert whole.keys() == dealt.keys() and {k: v[2] for k, v in whole.items()} == {k: v[2] for k, v in dealt.items()}
    # each label three times over: thresholds rest on three times as many
    thrice = weighed.withColumn("i", F.explode(F.array(*map(F.lit, range(3)))))
    assert all(personal.learned(thrice, 40, 0.95)[1][k][2] >= 3 * n for k, (_, _, n) in whole.items())
