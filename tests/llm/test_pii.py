import hashlib
import random
import re

from lithos.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    """The base kinds by their patterns."""
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub(r"[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda d=d: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}[kind]
            if ok():
                out.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def base(text):
    return [s for s in pii.spans(text.encode()) if s[0] in PATTERNS]


def test_base_spans_of_odd_texts():
    rng = random.Random(4)
    pieces = ["@", ".", "-", " ", "+", "1", "23", "255", "256", "0007", "a", "Bc", "é", "漢", "(", ")", "x.y", "4111111111111111", "\n", "%", "49927398716", "..", "  ", "ab@c.de", "1.2.3.4", "+1 (212) 555-0100"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        assert base(text) == brute(text), text
    for _ in range(3000):
        text = "".join(rng.choice("0123456789 -.") for _ in range(rng.randint(1, 60)))
        assert base(text) == brute(text), text
    assert base("a" * 5000 + "@b.c") == [("email", 0, 5004)] and base("1" * 6000) == []


def test_long_runs_take_time_in_proportion():
    for text in ("@" * 300_000, "a@" * 200_000, "1.2." * 100_000, "+1 " * 100_000, "9" * 400_000, "iban " * 60_000, "token = " * 40_000, "rue " * 80_000, "1 A street " * 20_000):
        pii.spans(text.encode())


def test_cues():
    found = lambda t: [(k, t[a:b]) for k, a, b in pii.spans(t.encode())]
    assert found("My IBAN: DE89 3704 0044 0532 0130 00 and more") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert found("IBAN: DE88 3704 0044 0532 0130 00, no") == []
    assert found("Account no. 1234-567-890.") == [("account", "1234-567-890")]
    assert found("on account of 12 people; accounts 123456") == []
    assert found("SSN: 078-05-1120 and Passport no. AB1234567.") == [("identity", "078-05-1120"), ("identity", "AB1234567")]
    assert found('é token = "908038b7daaf91" x') == [("secret", "908038b7daaf91")]
    assert found("password: hunter2hunter2") == [("secret", "hunter2hunter2")]
    assert found("the token = value, a password:") == []
    assert found("see https://example.com/news, or http://example.com/~ann.") == [("url", "http://example.com/~ann")]
    assert found("ftp://ann:pw@files.example.org/x ") == [("email", "pw@files.example.org"), ("url", "ftp://ann:pw@files.example.org/x")][::-1]
    assert found("at 221 Baker Street now") == [("address", "221 Baker Street")]
    assert found("in der Lindenstraße 12a.") == [("address", "Lindenstraße 12a")]
    assert found("au 12, rue de Rivoli à") == [("address", "12, rue de Rivoli à")] or found("au 12, rue de Rivoli.") == [("address", "12, rue de Rivoli")]
    assert found("the street with 3 trees, on the road again") == []


def test_scan_and_redact(spark, docs, texts, no_docs):
    got = sorted(((r.doc_id or -1), [tuple(s) for s in r.spans]) for r in pii.scan(docs).collect())
    assert got == sorted((i or -1, pii.spans((t or "").encode())) for i, t in texts)
    assert pii.scan(no_docs).count() == 0 and pii.redact(no_docs).count() == 0
    rows = spark.createDataFrame([("to ünï a.b@c.de or +1 212 555 0100.", 1), (None, 2), ("clean", 3)], "text string, spans int")
    assert [tuple(r) for r in pii.redact(rows).orderBy("spans").collect()] == [("to ünï <email> or <phone>.", 1), (None, 2), ("clean", 3)]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op11_pii(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in PATTERNS)
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    assert sum("secret" in r.spans for r in rows) > 5
    # clean texts are left alone: what the cues add to invented prose are its secrets
    assert {k for r in rows for k in re.findall("[a-z]+", r.spans)} <= {*PATTERNS, "secret"}
