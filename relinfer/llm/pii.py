"""PII (1): labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are found by patterns. Regex, gazetteer and context labelers vote on each of
them or abstain. Expectation-maximisation over the counts of vote patterns estimates
each labeler's reliability without labels; its posteriors train a logistic classifier on
features of the spans, which decides about the spans that the method adds.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relinfer.llm.common import add_columns, text_strings
from relinfer.session import cut

BASE = ["email", "ip", "card", "phone"]
# Kinds that the method adds: local phone numbers, numbers of persons, bank accounts, names, handles.
ADDED = ["phone_local", "person_id", "iban", "person", "handle"]
KINDS = BASE + ADDED

LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits without dot behind can't match at a later digit of it, so runs are tried from their start.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ADDED_PATTERNS = {
    "phone_local": re.compile(r"(?<![\w+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])"),
    "person_id": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "handle": re.compile(r"(?<![\w.@/])@[A-Za-z_][A-Za-z0-9_]{2,29}\b(?![.@])"),
}
# Gazetteers, and words in front of a span that speak for it or against it.
FIRST_NAMES = frozenset("""
alice amelia anna anne antonio ben carlos carmen charles charlotte chloe clara claire daniel david elena emily emma
eva felix francois frank george hannah hans heinrich henry isabel jack jacques james jan jane javier jean jennifer
jessica john jonas jose joseph juan julia karl katharina klaus laura lea leon linda louis lucas lucia lukas luis lena
manuel marc maria marie mark martin mary max michael miguel mohammed nicolas oliver olivia pablo patricia paul pedro
peter philippe pierre rafael richard robert rosa sarah sofia sophie stefan susan thomas tom ursula william wolfgang
""".split())
HONORIFICS = frozenset("mr mrs ms dr prof herr frau monsieur madame mme senor senora don dona sir lady".split())
COUNTRIES = frozenset("AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split())
CUES = {
    "phone_local": frozenset("phone tel telephone call mobile cell fax telefon telefono numero".split()),
    "person_id": frozenset("ssn social security id identity taxpayer tin passport dni nif".split()),
    "iban": frozenset("iban account bank transfer konto compte cuenta".split()),
    "person": frozenset("name contact signed author regards by from dear named called".split()) | HONORIFICS,
    "handle": frozenset("twitter follow instagram user handle mention contact via dm".split()),
}
# A name, in front of which cues are stepped over though they begin with a capital.
NAME = r"[A-ZÀ-Þ][a-zß-ÿ]++"
ADDED_PATTERNS["person"] = re.compile(
    rf"\b(?!(?:{'|'.join(sorted(w.capitalize() for w in CUES['person']))})\b){NAME}(?: [A-ZÀ-Þ]\.)? {NAME}\b"
)
AGAINST = frozenset("order invoice isbn issn version ref part serial item page figure table section chapter code sku".split())
CONTEXT_CHARS = 40

# A vote is 0 (abstains), 1 (for) or 2 (against); labelers in order.
LABELERS = ("regex", "checksum", "gazetteer", "context", "position")
N_FEATURES = 8
EM_ROUNDS, FIT_ROUNDS, RIDGE = 50, 30, 1.0
THRESHOLD = 0.5

RESULT = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern: for each @, the run of local characters in front and a domain behind."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        size = 64
        while True:
            front = text[max(last, at - size) : at]
            local = len(front) - len(front.rstrip(LOCAL_CHARS))
            if local < len(front) or at - size <= last:
                break
            size *= 4
        domain = DOMAIN.match(text, at + 1) if local else None
        if domain:
            out.append((at - local, last := domain.end()))
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _votes(kind: str, text: str, start: int, end: int) -> tuple[int, int]:
    """Votes of the labelers (two bits each) and features of the span (one bit each)."""
    span = text[start:end]
    before = re.findall(r"\w+", text[max(0, start - CONTEXT_CHARS) : start].lower())[-5:]
    after = text[end : end + 1]
    digits = _digits(span)
    words = span.lower().replace(".", "").split()
    cue, against = bool(CUES[kind].intersection(before)), bool(AGAINST.intersection(before))
    if kind == "phone_local":
        regex = 1 if digits[0] in "23456789" and digits[3] in "23456789" else 2
        checksum, gazetteer = 2 if len(set(digits)) < 3 else 0, 2 if digits[:3] in ("000", "911") else 0
    elif kind == "person_id":
        regex = 2 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
        checksum, gazetteer = 2 if len(set(digits)) < 3 else 0, 0
    elif kind == "iban":
        regex, checksum = (1 if 15 <= len(span.replace(" ", "")) <= 34 else 2), 1 if iban_valid(span) else 2
        gazetteer = 1 if span[:2] in COUNTRIES else 2
    elif kind == "person":
        regex, checksum = (1 if all(2 <= len(w) <= 15 for w in words[::2]) else 0), 0
        gazetteer = 1 if words[0] in FIRST_NAMES else 2
    else:
        regex, checksum, gazetteer = (2 if span[1:].isdigit() else 0), 0, 1 if words[0][1:] in FIRST_NAMES else 0
    context = 1 if cue and not against else 2 if against else 0
    # A span at the start of a sentence is often no name; one in brackets or behind a colon often is personal.
    previous = text[max(0, start - 2) : start]
    position = 2 if kind == "person" and (not previous.strip() or previous[0] in ".!?\n") else 1 if previous[-1:] in ":(<" or previous[-2:] == ": " else 0
    votes = sum(v << 2 * k for k, v in enumerate((regex, checksum, gazetteer, context, position)))
    bits = (
        cue, against, gazetteer == 1, checksum == 1, previous[-1:] in ":(<" or previous[-2:] == ": ",
        len(span) > 14, after in ("", ".", ",", ")", "\n", ";"), not previous.strip(),
    )
    return votes, sum(b << k for k, b in enumerate(bits))


def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, votes, features) of the added kinds that don't touch a base span."""
    base = [(a, b) for a, _, b in base_spans(text)]
    ends = np.maximum.accumulate([b for _, b in base]) if base else np.empty(0)
    starts = np.array([a for a, _ in base])
    out = []
    for name, pattern in ADDED_PATTERNS.items():
        kind = KINDS.index(name)
        for m in pattern.finditer(text):
            k = int(np.searchsorted(starts, m.end()))
            if not (k and ends[k - 1] > m.start()):
                out.append((kind, m.start(), m.end(), *_votes(name, text, *m.span())))
    return out


@dataclass
class Labelers:
    """Reliabilities by kind: share of true spans, and chances of each vote given true or false."""

    prior: np.ndarray
    chance: np.ndarray


def estimate(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[Labelers, np.ndarray]:
    """Expectation-maximisation over counted vote patterns; also the posterior of each pattern.

    It starts from the share of votes for, so that class 1 stays the class that the votes
    are for; counts are smoothed towards a labeler that is right three times in four.
    """
    table = np.stack([votes >> 2 * k & 3 for k in range(len(LABELERS))], 1)
    ayes, noes = (table == 1).sum(1), (table == 2).sum(1)
    posterior = (ayes + 0.5) / (ayes + noes + 1.0)
    kinds = len(KINDS)
    believed = np.array([[0.3, 0.2], [0.525, 0.2], [0.175, 0.6]])
    prior, chance = np.full(kinds, 0.5), np.zeros((kinds, len(LABELERS), 3, 2))
    for _ in range(rounds):
        for t in range(kinds):
            own = kind == t
            weight = n[own] * np.stack([posterior[own], 1 - posterior[own]])
            prior[t] = (weight[0].sum() + 1) / (weight.sum() + 2)
            for k in range(len(LABELERS)):
                seen = np.array([[weight[c][table[own, k] == v].sum() for c in (0, 1)] for v in (0, 1, 2)])
                seen = seen + 20 * believed / believed.sum(0)
                chance[t, k] = seen / seen.sum(0)
        log = np.log(np.stack([prior[kind], 1 - prior[kind]], 1))
        for k in range(len(LABELERS)):
            log = log + np.log(chance[kind, k, table[:, k]])
        posterior = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -50, 50)))
    return Labelers(prior, chance), posterior


def fit(kind: np.ndarray, features: np.ndarray, posterior: np.ndarray, n: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Weights (kinds, 1 + features) of a ridge logistic regression on soft labels, by Newton steps."""
    weights = np.zeros((len(KINDS), N_FEATURES + 1))
    for t in set(kind.tolist()):
        own = kind == t
        x = np.hstack([np.ones((own.sum(), 1)), np.stack([features[own] >> k & 1 for k in range(N_FEATURES)], 1)])
        w, y, m = weights[t], posterior[own], n[own].astype(float)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (m * (y - p)) - RIDGE * w
            hessian = (x * (m * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
            w = w + np.linalg.solve(hessian, gradient)
        weights[t] = w
    return weights


def train(found: DataFrame) -> np.ndarray:
    """Classifier from candidate spans (column `_found`), by counts of (kind, votes, features).

    There are at most 5 kinds x 243 vote patterns x 256 feature patterns of them, however many
    documents there are; they are summed by Spark, and only their counts are fitted here.
    """
    counted = (
        found.select(F.explode("_found").alias("s")).groupBy("s.kind", "s.votes", "s.features").count()
        .orderBy("kind", "votes", "features").collect()
    )
    if not counted:
        return np.zeros((len(KINDS), N_FEATURES + 1))
    kind, votes, features, n = (np.array(c) for c in zip(*counted))
    _, posterior = estimate(kind, votes, n)
    return fit(kind, features, posterior, n)


def _spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (long), base_sha256 and spans (string).

    Base spans are those of the fixed patterns. Added spans are the candidates to which
    the classifier gives more than THRESHOLD; none touches a base span. Null and empty texts
    have none; without candidates nothing is trained or added. Columns of these names are replaced, others
    carried. The texts are read once; what is found in them is written for the two
    steps that follow, the counts and the decision. No shuffle but that of counts.
    """
    found_type = "array<struct<kind: int, start: int, end: int, votes: int, features: int>>"
    struct = pa.struct([(c, pa.int32()) for c in ("kind", "start", "end", "votes", "features")])

    def look(batch: pa.RecordBatch) -> list[pa.Array]:
        counts, digests, based, found = [], [], [], []
        for text in text_strings(batch, text_col):
            spans = base_spans(text)
            kinds = [k for _, k, _ in spans]
            counts.append([kinds.count(k) for k in range(len(BASE))])
            spelled = _spell(spans)
            digests.append(hashlib.sha256(spelled.encode()).hexdigest())
            based.append([{"kind": k, "start": a, "end": b, "votes": 0, "features": 0} for a, k, b in spans])
            found.append([dict(zip(("kind", "start", "end", "votes", "features"), c)) for c in candidates(text)])
        return [
            *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(digests, pa.string()),
            pa.array(based, pa.list_(struct)), pa.array(found, pa.list_(struct)),
        ]

    columns = ", ".join(RESULT.split(", ")[:5])
    looked = cut(add_columns(docs, f"{columns}, _based {found_type}, _found {found_type}", look, drop=("spans", *drop)))
    weights = train(looked)
    kinds = F.array(*(F.array(*map(F.lit, map(float, row))) for row in weights))

    def accepted(s: F.Column) -> F.Column:
        w = F.element_at(kinds, s["kind"] + 1)
        score = F.element_at(w, 1)
        for k in range(N_FEATURES):
            score = score + F.element_at(w, k + 2) * F.shiftright(s["features"], k).bitwiseAND(1)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-score)) > THRESHOLD

    names = F.array(*map(F.lit, KINDS))
    spans = F.array_sort(F.transform(
        F.concat("_based", F.filter("_found", accepted)),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")),
    ))
    spelled = F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    ), ",")
    return looked.withColumn("spans", spelled).drop("_based", "_found")
