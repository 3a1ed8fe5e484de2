"""PII, licenses and secrets against plain regular expressions."""

import hashlib
import random
import re

import numpy as np
import pytest

from relinfer.llm import licenses, pii, secrets
from relinfer.llm.common import byte_words
from relinfer.llm.license_rules import ROOTS, RULES, rule_rows
from tests.conftest import FOLDER

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def digits(text):
    return [c for c in text if c in "0123456789"]


def pii_base(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 14 <= len(digits(m[0])) <= 19 and pii.luhn("".join(digits(m[0]))):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_base_on_random_texts():
    rnd = random.Random(3)
    for _ in range(3000):
        text = "".join(rnd.choice("a1.@-+ %(é5") for _ in range(60))
        assert pii.base_spans(text) == pii_base(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_of_documents(spark):
    rows = pii.find_pii(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()
    for r in rows:
        base = pii_base(r.text)
        spelled = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert hashlib.sha256(spelled.encode()).hexdigest() == r.base_sha256
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in base) for j in range(4))
        assert not spelled or set(spelled.split(",")) <= set(r.spans.split(","))


def test_added_pii(spark):
    texts = [
        "Contact: Anna Smith, phone (212) 555-1234, ssn 123-45-6789, IBAN DE89 3704 0044 0532 0130 00",
        "invoice 000-00-0000 and part 911-11-1111", "nothing here",
    ] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.text[:7]: r.spans for r in pii.find_pii(docs).collect()}
    kinds = [s.split(":")[0] for s in found["Contact"].split(",")]
    assert {"phone_local", "person_id", "iban"} <= set(kinds)
    assert found["invoice"] == "" and found["nothing"] == ""


def test_em_finds_reliabilities():
    """Votes drawn with known reliabilities: the posterior separates, the estimates come near."""
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    votes = np.zeros(len(truth), int)
    for k, right in enumerate((0.95, 0.8, 0.9, 0.7, 0.6)):
        vote = np.where(rng.random(len(truth)) < right, truth, ~truth)
        votes += np.where(vote, 1, 2) << 2 * k
    kind = np.full(len(truth), 4)
    labelers, posterior = pii.estimate(kind, votes, np.ones(len(truth), int))
    assert ((posterior > 0.5) == truth).mean() > 0.95
    assert abs(labelers.prior[4] - 0.3) < 0.03 and abs(labelers.chance[4, 0, 1, 0] - 0.95) < 0.03


def secret_base(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_base(spark):
    rnd = random.Random(5)
    pool = ["password", "TOKEN", "api_key", "apikey", "secret", ":", "=", " ", "'", '"', "abcdefgh1", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "x"]
    texts = ["".join(rnd.choice(pool) for _ in range(25)) for _ in range(400)]
    texts += [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan_secrets(docs).collect():
        spelled = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in secret_base(r.text))
        assert hashlib.sha256(spelled.encode()).hexdigest() == r.base_sha256, r.text
        assert not spelled or set(spelled.split(",")) <= set(r.spans.split(","))


KEY = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"[:40]


@pytest.mark.parametrize("text, kinds", [
    (f"client_id: foo1234 key {KEY} at https://s3.example.com/x", ["ident", "bare", "endpoint"]),
    (f"only {KEY} at https://s3.example.com/x", []),
    ("client_id: foo1234 at https://s3.example.com/x", []),
    (f"client_id: foo1234 {'. ' * 200} {KEY}", []),
    ("client_id: foo1234, secret: abcdefgh", ["ident", "assign"]),
])
def test_weak_parts_need_each_other(spark, text, kinds):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = secrets.scan_secrets(docs).first().spans
    assert [s.split(":")[0] for s in spans.split(",") if s] == kinds


def test_license_rules_hold_their_roots():
    assert len(RULES) > 200
    for rule in RULES:
        assert any(root in rule.key for root in ROOTS)


def resolved(words):
    """Detections by brute force over all rules, without prefilter."""
    norm = f" {' '.join(words)} "
    found = sorted(
        (m.start(), -m.end(), r["priority"], r["number"], r["label"]) for r in rule_rows() for m in re.finditer(r["regex"], norm)
    )
    out = []
    for x in found:
        if out and x[1] >= out[-1][1]:
            continue
        if out and x[0] < -out[-1][1]:
            if x[2] < out[-1][2]:
                out[-1] = x
            continue
        out.append(x)
    return out


def test_licenses(spark):
    rnd = random.Random(7)
    pool = "GNU General Public License, Apache License Version 2.0 CC BY SA 4.0 MIT License licensed under the BSD 3-clause all rights reserved é public domain".split(" ")
    texts = [" ".join(rnd.choice(pool) for _ in range(30)) for _ in range(150)]
    texts += [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    texts += ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software (MIT License)"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(docs).collect():
        words = [w.decode() for w in byte_words(r.text.encode())]
        places, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted(base))
        left = resolved(words)
        assert [(x.start, -x.end, x.rule) for x in r.licenses] == [(x[0], x[1], x[3]) for x in left]
        assert r.labels == ",".join(sorted(base | {x[4] for x in left})) and 0 <= r.score <= 1
