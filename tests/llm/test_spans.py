"""Licences, personal data and secrets: base places and spans against brute force over random texts, what the methods add, what
they refuse, and texts with very many matches."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from turnledger.llm import license_scan, pii, secret_scan
from turnledger.llm.pii_readings import luhn_ok


def spelled(spans, kinds):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, kinds.index(k), b, k) for k, a, b in spans))


def digits(text):
    return re.sub("[^0-9]", "", text)


def pii_base(text):
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(digits(v)) <= 19 and luhn_ok(digits(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(digits(v)) <= 15),
    }
    return [(kind, m.start(), m.end()) for kind, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m.group())]


def secret_base(text):
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return found + [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]


PIECES = ["joe", "@", ".", "mail", "com", "-", "+", " ", "(", ")", "1", "22", "255", "256", "4041894974608795", "4041 8949 7460 8795", "4041894974608796", "+1 (988) 555-2485", "a.b@c.de", "é", "日", "\n", "0.0.0.1", "@x", "%", "a@b"]
SECRETS = ["password", "Token", "api_key", "apikey", "SECRET", '"', "'", " ", "=", ":", "abcdefgh", "Zz9+/_.=-", "short", "AKIA", "ABCDEFGHIJ12", "0f1e2d3c", "deadbeef" * 4, "é", "\n", "passwd", "f" * 31]


def made(pieces, n, seed):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(n)] + [(n, None), (n + 1, ""), (None, "x"), (0, "again")]


def test_pii_base_brute_force(spark):
    rows = made(PIECES, 400, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("base", "email", "rest", "bits")})
    got = sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.pii_spans(docs).collect())
    want = []
    for i, t in rows:
        base = pii_base(t or "")
        want.append((str(i), hashlib.sha256(spelled(base, pii.KINDS).encode()).hexdigest(), *(sum(k == kind for k, *_ in base) for kind in pii.KINDS)))
    assert got == sorted(want)


def test_pii_method_adds_and_refuses(spark):
    found = {
        "mail me: joe at example dot com": "joe at example dot com", "contact ann.lee [at] sample [dot] org today": "ann.lee [at] sample [dot] org", "my card 4111.1111.1111.1111 was used": "4111.1111.1111.1111",
        "please call (030) 555-0142 now": "(030) 555-0142", "the server 10[.]2[.]3[.]44 is down": "10[.]2[.]3[.]44", "tel. 030/5550142": "030/5550142", "ip 192 dot 168 dot 0 dot 7": "192 dot 168 dot 0 dot 7",
    }
    refused = ["they met look at example.com later", "order 4111.1111.1111.1112 came", "invoice no 2024-01-15 10:30", "version 1 . 2 . 3 . 4", "sold 3 @ 15 each", "isbn 978-3-16-148410-0", "id 1234567890 is old", "the end at last. Then"]
    texts = [*found, *refused]
    out = {r.doc_id: r.spans for r in pii.pii_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        spans = [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in out[i].split(",") if s)]
        assert spans == ([found[text]] if text in found else []), text
        assert not pii_base(text)


def test_pii_readings_of_ones_own(spark):
    """The labels decide: the same form in the same place, taught as data or as a look-alike."""
    rows = [("phone", f"code 0{i:02}-55 {i:03} x", 5, 16 - 1, good) for good in (True,) for i in range(99)]
    docs = spark.createDataFrame([(1, "code 077-55 123 x")], "doc_id long, text string")
    schema = "kind string, text string, start long, end long, label boolean"
    assert pii.pii_spans(docs, readings=spark.createDataFrame(rows, schema)).first().spans == "phone:5:15"
    against = [(*r[:4], False) for r in rows]
    assert pii.pii_spans(docs, readings=spark.createDataFrame(against, schema)).first().spans == ""


def test_secret_base_brute_force(spark):
    rows = made(SECRETS, 400, 2)
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in rows], "doc_id long, text string, source string, lang string").withColumns({c: F.lit("clash") for c in ("hash", "found", "owner", "row_id")})
    got = sorted((str(r.doc_id), r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secret_scan.secret_spans(docs).collect())
    want = []
    for i, t in rows:
        base = secret_base(t or "")
        want.append((str(i), hashlib.sha256(spelled(base, secret_scan.KINDS).encode()).hexdigest(), *(sum(k == kind for k, *_ in base) for kind in secret_scan.BASE)))
    assert got == sorted(want)


def test_secret_ownership_decides(spark):
    value = "Ab3dE6gH9jK2mN5pQ8s%s"
    rows, want = [], {}

    def put(tag, places, kept):
        for owner, repository in places:
            rows.append((len(rows), f"see {value % tag} there", owner, repository))
            want[len(rows) - 1] = "mixed:4:25" if kept else ""

    put("A1", [(f"o{i}", f"r{i}") for i in range(5)], False)  # many owners
    put("B2", [("o1", f"r{i}") for i in range(9)], True)  # one owner, many repositories
    put("C3", [("o1", "r1"), ("o2", "r2")], True)  # two owners, few repositories
    put("D4", [("o1", f"r{i}") for i in range(4)] + [("o2", f"q{i}") for i in range(4)], False)  # two owners, many repositories
    put("E5", [("o1", "r1"), ("o2", "r2"), ("o3", "r3")], False)  # exactly shared_by
    put("F6", [(None, None), (None, None)], True)  # null owners are one
    out = secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string"), owner=F.col("owner"), repository=F.col("repo")).collect()
    assert {r.doc_id: r.spans for r in out} == want
    assert all(r.dropped == ("" if r.spans else "mixed:4:25") and r.n_live == bool(r.spans) for r in out)
    base = spark.createDataFrame([(i, "token = abcdefgh12345", f"o{i}", "r") for i in range(4)], "doc_id long, text string, owner string, repo string")
    for r in secret_scan.secret_spans(base, owner=F.col("owner"), repository=F.col("repo")).collect():
        assert r.spans == "assign:0:21" == r.examples and r.dropped == "" and r.most_owners == 4  # base spans stay


def by_regex(template):
    """The template as a regular expression over words, each followed by a space."""
    out, end = "", 0
    words = lambda part: "".join(re.escape(w.decode()) + " " for w in license_scan.words(part.encode()))
    for m in license_scan._MARK.finditer(template):
        out += words(template[end : m.start()])
        end = m.end()
        if m[1] == "beginOptional":
            out += "(?:"
        elif m[1] == "endOptional":
            out += ")?"
        else:
            low, high = re.search(r'words="(\d+)\.\.(\d+)"', m[1]).groups()
            out += rf"(?:\S+ ){{{low},{high}}}"
    return out + words(template[end:])


TEMPLATES = {
    "a": 'one <<beginOptional>>two <<beginOptional>>three<<endOptional>> four<<endOptional>> five <<var;name="x";original="y > z";words="0..2">> six',
    "b": '<<beginOptional>>two<<endOptional>> <<var;name="x";original="";words="1..2">> five <<beginOptional>>six<<endOptional>>', "c": "three four",
}


@pytest.mark.parametrize("seed", range(3))
def test_license_automata_brute_force(seed):
    rng, automata = random.Random(seed), {k: license_scan.compile_template(k, t) for k, t in TEMPLATES.items()}
    for _ in range(300):
        text = [rng.choice("one two three four five six".split()) for _ in range(rng.randrange(12))]
        for label, template in TEMPLATES.items():
            pattern = re.compile(by_regex(template))
            for at in range(len(text)):
                ends = [e for e in range(at, len(text) + 1) if pattern.fullmatch("".join(w + " " for w in text[at:e]))]
                assert automata[label].match([w.encode() for w in text], at) == max(ends, default=-1), (label, text, at)


def test_license_scan_brute_force(spark):
    rng = random.Random(9)
    vocabulary = "cc by all rights reserved general public license licensed under CC BY 4.0 MIT, (x) é".split()
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(300)] + [(None, None), (1, "")]
    patterns = {k: re.compile("(?<![^ ])" + by_regex(t)) for k, t in license_scan.TEMPLATES.items()}
    for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))).collect():
        text = next(t for i, t in rows if i == r.doc_id and (i != 1 or r.n_words or not t)) if r.doc_id != 1 else None
        if text is None and r.doc_id == 1:
            continue
        w = [x.decode() for x in license_scan.words((text or "").encode())]
        starts = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        line = "".join(x + " " for x in w)
        labels = {label for _, label in starts} | {k for k, p in patterns.items() if p.search(line)}
        assert (r.n_words, r.n_base, r.base_labels, r.labels) == (len(w), len(starts), ",".join(sorted({x for _, x in starts})), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == (min((i for i, _ in starts), default=None), max((i for i, _ in starts), default=None))


def test_license_whole_texts():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.BASE)
    for label in ("mit-text", "isc-text", "bsd-text", "zlib-text", "apache-2.0-notice", "gpl-notice"):
        full = re.sub(r'<<var;name="[^"]*";original="([^"]*)"[^>]*>>', r"\1", license_scan.TEMPLATES[label])
        bare = re.sub(r"<<beginOptional>>(?:(?!<<beginOptional>>).)*?<<endOptional>>", " ", full, flags=re.S)
        bare = re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", bare, flags=re.S)
        for text in (re.sub("<<[a-zA-Z]*>>", " ", full), bare):
            w = license_scan.words(("before it " + text + " after").encode())
            assert label in {x for *_, x in scanner.scan(w)["spans"]}, (label, text)
            without = w[:-2] + w[-1:]  # its last word is mandatory, but for gpl-notice
            assert label not in {x for *_, x in scanner.scan(without)["spans"]} or label == "gpl-notice"


def test_very_many_matches(spark):
    """Long texts in linear time: four times the matches take less than twelve times as long."""

    def timed(n):
        text = "a.b@c.de 1.2.3.4 +1 988 555 2485 token = abcdefgh12 joe [at] x [dot] com " * n
        docs = spark.createDataFrame([(1, text, "s", "en")], "doc_id long, text string, source string, lang string")
        began = time.time()
        p, s = pii.pii_spans(docs).first(), secret_scan.secret_spans(docs).first()
        assert (p.n_email, p.n_ip, p.n_phone, s.n_assign) == (n, n, n, n)
        return time.time() - began

    timed(10)
    assert timed(20_000) < 12 * max(4.0, timed(5_000))
