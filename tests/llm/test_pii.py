"""Personal data: base spans against regular expressions, the graph's scores, discovery."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from trackframe.llm import pii
from trackframe.llm.common import apart
from trackframe.llm.queries import op7_personal_data


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, name, m.end()) for k, (name, p, good) in enumerate(kinds) for m in re.finditer(p, text or "") if good(m))


def check(rows, docs):
    by = {}
    for i, t in docs:
        s = brute(t)
        by.setdefault(i, []).append((*(sum(x[2] == k for x in s) for k in pii.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in s).encode()).hexdigest()))
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r)[1:6] in by[r[0]], r


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = op7_personal_data(spark, sf).collect()
    check(rows, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_base_edges(spark):
    rnd = random.Random(6)
    texts = [
        None, "", "a@b.c%d@e.f", "a@@b@c.d x@y", "abc@def@ghi.com.", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.0003.255", "4111 1111-1111 1111 4111111111111112", "+1 (123) 555-1234 +12 +1234567890123456",
        "1" * 50_000, "a" * 50_000, "1." * 9_000, "漢𝒳 +49 30 1234567 é x.y@z.de", "+1 " + " " * 20_000 + "2", "4111  1111 1111 1111", "٣٤@x.y 1٣.1.1.1",
    ]
    parts = ["a", "@", ".", "1", "23", " ", "-", "+", "(", ")", "255", "4111111111111111", "é", "\n", "%", "x.y"]
    texts += ["".join(rnd.choices(parts, k=rnd.randint(1, 30))) for _ in range(300)]
    docs = list(enumerate(texts)) + [(0, None), (None, "mail me@example.org")]
    frame = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, base string")
    check(pii.digests(pii.scan(frame)).collect(), docs)
    assert pii.scan(frame.limit(0)).count() == 0


def test_confident_contexts_discover_identifiers(spark):
    rnd = random.Random(3)
    words = [f"w{x}x" for x in "abcdefghijklmnopqrstuvwxyz"]
    filler = lambda n: " ".join(rnd.choices(words, k=n))
    docs = [(i, f"{filler(20)} call us on +1 555 {rnd.randint(1000000, 9999999)} {filler(9)}") for i in range(30)]
    docs += [(100 + i, f"{filler(9)} call us on EXT-{rnd.randint(10000, 99999)}, {filler(9)}") for i in range(4)]
    docs += [(200 + i, f"{filler(9)} {rnd.choice(words)} part {rnd.randint(10000, 99999)} {filler(9)}") for i in range(40)]
    rows = {r.id: r for r in pii.digests(pii.scan(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    text = dict(docs)
    for i in range(100, 104):
        (kind, a, b), = [x.split(":") for x in rows[i].spans.split(",")]
        assert kind == "context" and re.fullmatch(r"EXT-\d{5}", text[i][int(a) : int(b)])
    assert not any(r.n_context for i, r in rows.items() if i >= 200 or i < 100)


def test_scores_equal_plain_arithmetic(spark):
    rnd = random.Random(12)
    edges = {(rnd.randint(1, 12), rnd.randint(1, 60)) for _ in range(260)}
    seeds = {i for i in range(1, 61) if rnd.random() < 0.6}
    belief = {i: float(i in seeds) for i in range(1, 61)}
    for _ in range(3):
        conf = {}
        for p in {p for p, _ in edges}:
            own = [belief[i] for q, i in edges if q == p]
            if sum(b >= 0.5 for b in own) >= 3:
                conf[p] = sum(own) / (len(own) + 1)
        for i in belief:
            if i not in seeds:
                doubt = 1.0
                for p, j in edges:
                    doubt *= 1 - conf.get(p, 0) if j == i else 1
                belief[i] = 1 - doubt
    got = {r.pattern: r.confidence for r in pii.confidences(spark.createDataFrame([(p, i, i in seeds) for p, i in edges], "pattern long, instance long, seed boolean")).collect()}
    assert got.keys() == conf.keys()
    assert all(abs(got[p] - conf[p]) < 1e-9 for p in conf)


def brute_context(docs):
    """{row: [(start, end)]} that confident contexts add, by plain loops over all occurrences."""
    run = "A-Za-z0-9@._%+/#-"
    token = re.compile(rf"(?<![{run}])[A-Za-z@._%+/#-]*[0-9][{run}]*")
    patterns_of = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    seen = []  # (row, start, end, seed, instance, patterns)

    def patterns(text, a, b):
        left, right = text[a[0] : a[1]], text[b[0] : b[1]]
        left = re.sub(r"\A\S*", "", left[-61:]) if len(left) > 60 else left
        right = re.sub(r"\S*\Z", "", right[:61]) if len(right) > 60 else right
        left, right = (re.sub("[0-9]", "0", x).lower().split() for x in (left, right))
        out = [("two", *left[-2:])] if len(left) > 1 else []
        out += [("around", left[-1], right[0])] if left and right else []
        out += [("label", left[-1])] if left and re.search(r"[^\W\d_].*[:=#]\Z", left[-1]) else []
        return out

    for row, text in enumerate(docs):
        text = text or ""
        base = brute(text)
        for name, pattern in [*patterns_of, ("token", token.pattern)]:
            found = list(re.finditer(pattern, text))
            for i, m in enumerate(found):
                before = (found[i - 1].end() if i else 0, m.start())
                after = (m.end(), found[i + 1].start() if i + 1 < len(found) else len(text))
                if name != "token":
                    if any(x[0] == m.start() and x[2] == name for x in base):
                        seen.append((row, m.start(), m.end(), True, m[0], patterns(text, before, after)))
                elif sum(c.isdigit() for c in m[0]) >= 4:
                    own = re.sub(r"[._%+/#-]+\Z", "", m[0])
                    a, b = m.start(), m.start() + len(own)
                    if not any(x[0] < b and a < x[3] for x in base):
                        seen.append((row, a, b, False, own, patterns(text, before, after)))
    edges = {}
    for _, _, _, seed, instance, own in seen:
        for p in own:
            edges[p, instance] = edges.get((p, instance), False) or seed
    belief = {}
    for _ in range(pii.ROUNDS):
        confidence = {}
        for p in {p for p, _ in edges}:
            own = [1.0 if seed else belief.get(i, 0.0) for (q, i), seed in edges.items() if q == p]
            if sum(x >= pii.BELIEVED for x in own) >= pii.SUPPORT:
                confidence[p] = sum(own) / (len(own) + pii.SMOOTHING)
        belief, doubt = {}, {}
        for (p, i), seed in edges.items():
            if not seed and p in confidence:
                doubt[i] = doubt.get(i, 1.0) * max(1 - confidence[p], 1e-6)
        belief = {i: 1 - x for i, x in doubt.items()}
    good = {p for p, x in confidence.items() if x >= pii.CONFIDENCE}
    out = {}
    for row, a, b, seed, _, own in seen:
        if not seed and good & set(own):
            out.setdefault(row, set()).add((a, b))
    return out


def planted(seed):
    """(text, span of the unseen identifier or None): seeds and unseen identifiers share contexts; ordinary numbers have their own."""
    rnd = random.Random(seed)
    words = [f"w{x}{y}" for x in "abcdefgh" for y in "ijklmnop"]
    filler = lambda n: " ".join(rnd.choices(words, k=n))
    digits = lambda n: "".join(rnd.choices("0123456789", k=n))
    contexts = ["call us on", "Tel:", "mail to:", "my server at", "paid by card number", "write to me under", "(mobile phone)"]
    seeds = [lambda: f"+1 555 {digits(7)}", lambda: f"u{digits(5)}@example{rnd.randint(1, 9)}.org", lambda: f"{rnd.randint(1, 255)}.{rnd.randint(0, 255)}.0.{rnd.randint(1, 255)}"]
    unseen = [lambda: f"EXT-{digits(5)}", lambda: f"0171-{digits(7)}", lambda: f"user#{digits(6)}", lambda: f"id{digits(80)}", lambda: f"DE{digits(20)}"]
    docs = []
    for _ in range(260):
        docs.append((f"{filler(12)} {rnd.choice(contexts)} {rnd.choice(seeds)()} {filler(8)}", None))
    for _ in range(120):
        start, found = f"{filler(12)} {rnd.choice(contexts)} ", rnd.choice(unseen)()
        docs.append((f"{start}{found}, {filler(8)}", (len(start), len(start) + len(found))))
    for _ in range(200):
        docs.append((f"{filler(9)} {rnd.choice(['page', 'part', 'in the year', 'Total:'])} {digits(rnd.randint(4, 9))} {filler(8)} {'x' * 70} {digits(5)} {'y' * 70} {filler(2)}", None))
    rnd.shuffle(docs)
    return docs


def test_spans_equal_brute_force_and_recall(spark):
    docs = planted(4)
    texts = [t for t, _ in docs] + [None, "", "call us on", "Tel: 12345", "call us on 1234 and Tel: a@b.c 99999 é"]
    rows = pii.digests(pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    want, found = brute_context(texts), {}
    for r in rows:
        spans = sorted([*brute(texts[r.id]), *((a, 4, "context", b) for a, b in want.get(r.id, ()))])
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans), texts[r.id]
        found[r.id] = {(a, b) for a, b in want.get(r.id, ())}
    hidden = [i for i, (_, span) in enumerate(docs) if span]
    recall = sum(docs[i][1] in found[i] for i in hidden) / len(hidden)
    extra = sum(len(found[i]) for i, (_, span) in enumerate(docs) if not span)
    print("recall", recall, "of ordinary rows", extra)
    assert recall >= 0.9 and not extra


def test_tokens_apart_from_spans_equal_all_pairs(spark):
    rnd = random.Random(9)

    def stretches(n, size):
        cuts = sorted(rnd.sample(range(size), 2 * n))
        return [(a, b) for a, b in zip(cuts[::2], cuts[1::2])]

    rows = [([], []), ([(0, 3)], []), ([], [(0, 3)]), ([(0, 3)], [(3, 5)]), ([(3, 5)], [(0, 3)]), ([(3, 5), (1, 9)], [(0, 2), (4, 5), (9, 11)])]
    rows += [(stretches(a, 9000) + stretches(c, 9000), stretches(b, 9000)) for a, b, c in [(1, 9, 0), (400, 700, 3), (700, 2000, 200), (3, 1500, 3), (1024, 512, 0)]]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s array<struct<start:long,end:long>>, o array<struct<start:long,end:long>>")
    got = {r.i: [tuple(x) for x in r.f] for r in frame.select("i", apart(F.col("s"), F.col("o")).alias("f")).collect()}
    assert got == {i: [(a, b) for a, b in o if not any(c < b and a < d for c, d in s)] for i, (s, o) in enumerate(rows)}


def test_a_long_text_full_of_identifiers(spark):
    text = " ".join(f"from 10.{i % 250}.{i // 250}.7 user K{i * 7919 % 100003:05d}x" for i in range(6000))
    docs = [(1, text), (2, "no more")]
    rows = pii.digests(pii.scan(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    check(rows, docs)
    assert {r.id: r.n_ip for r in rows} == {1: 6000, 2: 0}
