import hashlib
import random
import re

from sieveline.llm import secrets
from sieveline.storage import cut

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def draw(rnd):
    bits = ["password", "PASSWD", "Secret", "token", "api_key", "ApiKey", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "abc", "abcdef", "/x+.=-", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789ab", "é", "\n", "AKIAAKIA"]
    return "".join(rnd.choice(bits) for _ in range(rnd.randrange(30)))


def test_base_rules():
    rnd = random.Random(8)
    for _ in range(20000):
        t = draw(rnd)
        assert secrets.scan_text(t, secrets.BASE) == brute(t), t


def test_more_rules():
    pem = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    t = f"é {pem} https://u:pw@host ghp_{'a' * 36}"
    kinds = [(k, t[a:b]) for k, a, b in secrets.scan_text(t, secrets.MORE)]
    assert kinds == [("private_key", pem), ("url_login", "https://u:pw@"), ("github", "ghp_" + "a" * 36)]


def test_long_texts_cost_what_they_are_long():
    import time

    pem = "-----BEGIN PRIVATE KEY-----"
    end = pem.replace("BEGIN", "END")
    for t in (f"{pem}\n" * 40_000, "eyJaaaaaaaaa-" * 80_000, "eyJaaaaaaaaaa.eyJ" * 50_000, f"{end}{pem}" * 20_000):
        began = time.perf_counter()
        secrets.scan_text(t)
        assert time.perf_counter() - began < 3
    t = f"{end} {pem} {pem} x {end} {pem} y {end} {end} {pem}"
    want = [m.span() for m in re.finditer(rf"{pem}[\s\S]*?{end}", t)]
    assert [(a, b) for _, a, b in secrets.scan_text(t, (secrets.MORE[0],))] == want and len(want) == 2


def test_query(spark):
    from sieveline.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"  # the smallest tables have no secret
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op9_secrets"](spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
    for r in rows:
        base = brute(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= {*r.spans.split(",")}


def test_tables(spark):
    rnd = random.Random(4)
    rows = [(i, draw(rnd), "x") for i in range(60)] + [(100 + i, "token = abcdefgh", "y") for i in range(50)]
    rows += [(7, rows[7][1], "x"), (None, "secret: 1234567", None), (201, None, None), (202, "", None), (203, "w " * 300_000 + "AKIA" + "A" * 16, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, blob string")
    got = sorted(map(tuple, secrets.digest(secrets.scan(docs)).collect()), key=str)
    want = []
    for i, t, _ in rows:
        base, spans = brute(t or ""), secrets.scan_text(t or "")
        join = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        n = [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]
        want.append((i, *n, hashlib.sha256(join(base).encode()).hexdigest(), join(spans)))
    assert got == sorted(want, key=str)
    assert secrets.scan(docs.limit(0)).collect() == []


def test_ledger_scans_only_what_is_new(spark):
    one = spark.createDataFrame([("a", 1, "token = abcdefgh"), ("b", 1, "token = abcdefgh"), ("c", 1, "no")], "path string, v long, t string")
    two = one.union(spark.createDataFrame([("a", 2, "AKIA" + "A" * 16)], one.schema))
    read = lambda df: secrets.versions(df, "path", "t", "v")
    ledger = cut(secrets.update(read(one), None, secrets.BASE))
    assert ledger.count() == 2 * 3
    new = cut(secrets.update(read(two), ledger, secrets.BASE))
    assert new.count() == 3  # one blob, three rules
    both = ledger.unionByName(new)
    assert secrets.update(read(two), both, secrets.BASE).count() == 0
    newer = (secrets.Rule("assign", secrets.BASE[0].pattern, 2, 2, 3), *secrets.BASE[1:])
    again = cut(secrets.update(read(two), both, newer))
    assert {r.rule for r in again.collect()} == {"assign@2"} and again.count() == 3
    found = {(r.path, r.version): [s.kind for s in r.spans] for r in secrets.findings(read(two), both.unionByName(again), newer).collect()}
    assert found == {("a", 1): ["assign"], ("b", 1): ["assign"], ("c", 1): [], ("a", 2): ["access"]}


def test_redact():
    assert secrets.redact("x abc def", [("k", 2, 5), ("j", 4, 6)]) == "x [k]def"
    assert secrets.redact("abc", []) == "abc"
