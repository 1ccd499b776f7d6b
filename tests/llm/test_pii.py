import random
import re

from pyspark.sql import functions as F

from ledgerlake.llm.common import running
from ledgerlake.llm.pii import estimate_reliabilities, find_pii, op3_pii, redact

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    None, "", "plain", "a@b.c_d@e.f", "x.y@z", "a@b@c.de, q@r.s.t.", "é a@b.cd ü +49 (30) 1234-5678 9", "1.2.3.4.5.6.7.8", "256.1.1.1 and 0001.002.3.255", "1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "41111111111111111111111111111", "x4111111111111111-", "4111  1111 1111 1111", "+1", "+12 3", "+1234567890123456", "++1 (234) 567-8901.",
    "call tel 0171 123 45678 or phone (555) 123-4567", "mail me: jane [at] example [dot] org now", "visa 4111111111111112", "9 9 9 9 9 9 9 9 9 9 9 9 9 9 9 9", "1 " * 5000, "5" * 20000, "a" * 50000 + "@", "a.b" * 5000 + "@c" + ".d" * 5000,
    "+1 " + "(" * 20000 + "5", "😀 a@b.co 😀 192.168.0.1",
]


def check(rows):
    for text, spans in rows:
        base = [s for s in spans if s.base]
        names = ("email", "ip", "card", "phone")
        assert [f"{names[s.kind]}:{s.start}:{s.end}" for s in base] == brute(text), (text or "")[:80]
        assert spans == sorted(spans, key=lambda s: (s.kind, s.start))


def test_edges(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string").selectExpr("*", "'x' as spans", "1 as kind", "2 as s")
    rows = find_pii(df).collect()
    check([(r.text, r.spans) for r in rows])
    assert len(rows) == 2 * len(TEXTS)


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import hashlib

    for r in op3_pii(spark, SF).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) or not want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in PLAIN]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.cd, 192.168.0.1 x"), (2, None), (3, "none"), (4, "+4111 1111 1111 111 1")], "doc_id long, text string").selectExpr("*", "'x' as spans", "1 as doc")
    rows = redact(df).collect()
    assert all((r.spans, r.doc) == ("x", 1) for r in rows)
    out = {r.doc_id: r.text for r in rows}
    assert out[1] == "é [EMAIL], [IP] x" and out[2] is None and out[3] == "none"
    assert "1111" not in out[4]


def test_empty(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_em_tells_good_labelers_from_noise():
    # the first labeler agrees with the second, the last one is a coin
    patterns = [((1, 1, 0, 0, c), 400.0) for c in (-1, 1)] + [((-1, -1, 0, 0, c), 400.0) for c in (-1, 1)] + [((1, 0, 0, 0, -1), 20.0), ((-1, 0, 0, 0, 1), 20.0)]
    soft, prior = estimate_reliabilities(patterns)
    assert soft[4] > 0.9 and soft[5] < 0.1 and 0.4 < prior < 0.6


def test_long_text_with_100000_addresses(spark):
    df = spark.createDataFrame([(1, "ab@c.de 1 " * 100_000)], "doc_id long, text string")
    row = redact(df).first()
    assert row.text == "[EMAIL] 1 " * 100_000


def test_running_is_a_prefix_fold(spark):
    values = [(i * 37) % 11 for i in range(1000)]
    df = spark.createDataFrame([(values,), ([],), ([5],)], "v array<int>")
    for r in df.select("v", running(F.col("v"), lambda a, b: a + b).alias("s"), running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))]
        assert r.m == [max([0, *r.v[:i]]) for i in range(len(r.v))]


def test_added_spans_are_mostly_right(spark):
    """Planted personal data in other forms than the base patterns, beside harmless strings of the same forms."""
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    true, rows = {}, []
    for i in range(1200):
        lead, form = " ".join(word() for _ in range(6)), i % 8
        body, before, good = {
            0: (f"{word()} [at] {word()} [dot] org", rng.choice(["mail ", "contact: ", ""]), True),
            1: (f"{word()}.{word()} (at) {word()}.com", rng.choice(["email ", "write to ", ""]), True),
            2: (f"0{digits(3)} {digits(3)}{digits(4)}", rng.choice(["tel ", "phone: ", "call "]), True),
            3: (f"({digits(3)}) {digits(3)}-{digits(4)}", rng.choice(["fax ", "mobile ", "", "dial "]), True),
            4: (f"{rng.randint(1, 255)}[.]{rng.randint(0, 255)}[.]{rng.randint(0, 255)}[.]{rng.randint(0, 255)}", rng.choice(["server ", "host ", ""]), True),
            5: (f"{digits(3)} {digits(3)}-{digits(3)}", "order #", False),
            6: (f"{word()}@{word()}.com", "mail ", None),
            7: (f"+{digits(2)} {digits(9)}", "phone ", None),
        }[form]
        text = f"{lead} {before}{body} {word()}"
        at = len(lead) + 1 + len(before)
        rows.append((i, text))
        true[i] = ((at, at + len(body)), good)
    found = {r.doc_id: {(s.start, s.end) for s in r.spans if not s.base} for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    planted = [i for i, (_, good) in true.items() if good]
    hit = sum(true[i][0] in found[i] for i in planted)
    wrong = sum(len(v - {true[i][0]} if true[i][1] else v) for i, v in found.items())
    assert hit / len(planted) > 0.9 and hit / (hit + wrong) > 0.9
