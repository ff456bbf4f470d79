"""Personal data by weak supervision.

Base detection: four exact patterns (email, ip, card, phone).  Matches that
fail their check are dropped.  The method looks at more *candidates*: what
the base patterns matched, failing matches, and looser forms (obfuscated
e-mail addresses, telephone numbers without a plus sign).  Labelers vote on
each candidate with -1, 0 or 1: regular expressions (strict form, usual
grouping), checks of value, gazetteers (card issuers, top-level domains,
reserved addresses, area codes) and context (cue words before the span,
characters around it).

Votes are counted per (kind, votes, features) over all texts, a table
bounded by the numbers of their values.  From it, expectation-maximisation
estimates per kind how reliable each labeler is and how probable each
vote pattern makes personal data; these soft labels train a logistic
classifier on the features alone (form, lengths, neighbours; no votes).
Candidates that the classifier accepts and that overlap no base span and no
accepted span before them join the base spans, which always stay.

Null and empty texts have no spans.  Rows are judged one by one, so repeated
rows get equal results.  Without candidates nothing is trained.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftcore.llm.common import materialize, prepare

KINDS = ("email", "ip", "card", "phone")

EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match always begins with a run of digits: without the look behind, a long run is tried from each of its digits
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL_LOOSE = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]+(?: ?(?:[\[({] ?dot ?[\])}]|\.) ?[A-Za-z0-9-]+)+", re.IGNORECASE)
PHONE_LOOSE = re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])")
DIGIT = re.compile("[0-9]")

#: Gazetteers: common top-level domains, and first digits of card issuers.
DOMAINS = frozenset("com org net edu gov mil int info io co biz de fr es uk us ca au jp cn in it nl ch at be se no dk fi pl pt br mx ar ru eu me dev app ai".split())
ISSUERS = ("34", "37", "36", "38", "30", "4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "60", "62", "64", "65", "35", "50", "56", "57", "58", "63", "67")
CUES = {
    "email": ("mail", "contact", "write to", "@", "adres", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login", "from"),
    "card": ("card", "visa", "master", "amex", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "appel", "llam", "ruf"),
}
AGAINST = ("version", "isbn", "issn", "token", "hash", "sha", "order", "serial", "password", "key", "release", "doi")
LABELERS = ("strict", "grouping", "value", "gazetteer", "context", "edges")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    """The check that a base match must pass."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(p) <= 255 if len(p) < 10 else int(p.lstrip("0")[:4] or 0) <= 255 and len(p.lstrip("0")) <= 3 for p in s.split("."))
    digits = _digits(s)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _emails(run: str) -> list[tuple[int, int]]:
    """Matches of the email pattern in a run of its characters, in linear time:
    a local part takes all since the @ or the match before it."""
    out, begin, end, at = [], 0, 0, run.find("@")
    while at >= 0:
        begin = max(begin, end)
        if at > begin and (m := DOMAIN.match(run, at + 1)):
            end = m.end()
            out.append((begin, end))
        begin, at = at + 1, run.find("@", at + 1)
    return out


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of all candidates, by start, then kind."""
    out = []
    if "@" in text:
        for run in EMAIL_RUN.finditer(text):  # a match never leaves its run
            if "@" in run[0]:
                out += [(run.start() + a, 0, run.start() + b, True) for a, b in _emails(run[0])]
    if ("[" in text or "(" in text or "{" in text) and "at" in text.lower():
        out += [(m.start(), 0, m.end(), False) for m in EMAIL_LOOSE.finditer(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end(), valid("ip", m[0])) for m in IP.finditer(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and len(_digits(m[0])) >= 12:
                out.append((m.start(), 2, m.end(), valid("card", m[0])))
        if "+" in text:
            out += [(m.start(), 3, m.end(), valid("phone", m[0])) for m in PHONE.finditer(text)]
        out += [(m.start(), 3, m.end(), False) for m in PHONE_LOOSE.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[1], -x[2], not x[3]))


def _sign(yes: bool, no: bool) -> int:
    return 1 if yes else -1 if no else 0


def votes(text: str, start: int, kind: int, end: int, base: bool) -> tuple[int, ...]:
    name, s = KINDS[kind], text[start:end]
    before, around = text[max(0, start - 24):start].lower(), (text[start - 1:start], text[end:end + 1])
    digits = _digits(s)
    if name == "email":
        grouping, value = "." in s.rpartition("@")[2], not (s.startswith(".") or ".." in s or "-." in s)
        last = re.split(r"[.\s\])}]+", s.strip(".])} "))[-1].lower()
        gazetteer = _sign(last in DOMAINS, len(last) < 2 or last.isdigit())
    elif name == "ip":
        parts = s.split(".")
        grouping, value = all(len(p) <= 3 and (p == "0" or p[0] != "0") for p in parts), valid("ip", s)
        gazetteer = _sign(parts[0].lstrip("0") not in ("", "127") and value and int(parts[0]) < 224, parts[0].strip("0") == "" or not value)
    elif name == "card":
        grouping, value = len(digits) in (13, 15, 16, 19), valid("card", s)
        gazetteer = _sign(digits.startswith(ISSUERS), digits[0] in "0189")
    else:
        grouping, value = bool(re.search(r"[0-9]{3}[\x20).-]+[0-9]{3}[\x20.-][0-9]{4}$", s)), 9 <= len(digits) <= 15
        area = digits[-10:-7]
        gazetteer = _sign(len(area) == 3 and area[0] in "23456789", len(area) == 3 and area[0] in "01" and not s.startswith("+"))
    edge = [bool(c) and (c.isalnum() or c in "_@") for c in around]
    return (
        _sign(base, not value), _sign(bool(grouping), False), _sign(bool(value), not value), gazetteer,
        _sign(any(c in before for c in CUES[name]), any(c in before for c in AGAINST)), _sign(not any(edge), any(edge)),
    )


def traits(text: str, start: int, kind: int, end: int) -> tuple[int, ...]:
    """Small whole numbers that describe form and neighbours of a span."""
    s = text[start:end]
    digits = len(_digits(s))
    marks = sum(not c.isalnum() for c in s)
    a, b = text[start - 1:start], text[end:end + 1]
    side = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3
    return (kind, min(20, digits), min(6, marks), min(4, (end - start) // 8), int(s[0] == "+"), int("@" in s), side(a), side(b), int(kind == 2 and luhn(_digits(s))), int(kind == 1 and valid("ip", s)))


def fit_labels(kind: np.ndarray, vote: np.ndarray, count: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probability that each row's span is personal data, by expectation-
    maximisation over labelers that err independently of each other."""
    out = np.zeros(len(kind))
    for k in np.unique(kind):
        rows = kind == k
        v, n = vote[rows], count[rows].astype(float)
        p = 1 / (1 + np.exp(-v.sum(1)))  # to begin with, the majority
        for _ in range(rounds):
            prior = (n @ p + 1) / (n.sum() + 2)
            logit = np.full(len(n), np.log(prior / (1 - prior)))
            for j in range(v.shape[1]):
                for value in (-1, 0, 1):
                    said = v[:, j] == value
                    # smoothed by three rows of which a right labeler has the larger part
                    yes = (n[said] @ p[said] + (1, 1, 1.5)[value + 1] - 0.5 * (value == -1)) / (n @ p + 3)
                    no = (n[said] @ (1 - p[said]) + (1.5, 1, 1)[value + 1] - 0.5 * (value == 1)) / (n @ (1 - p) + 3)
                    logit[said] += np.log(yes) - np.log(no)
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        out[rows] = p
    return out


class SpanClassifier:
    """Logistic regression on one-hot traits, fitted to soft labels."""

    def __init__(self, trait: np.ndarray, label: np.ndarray, count: np.ndarray, rounds: int = 300, ridge: float = 1.0):
        self.columns = {key: i for i, key in enumerate(sorted({(j, int(x)) for j in range(trait.shape[1]) for x in np.unique(trait[:, j])}))}
        x, n = self._hot(trait), count.astype(float)
        self.w = np.zeros(x.shape[1])
        for _ in range(rounds):  # Newton steps, damped by the ridge
            p = 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))
            slope = x.T @ (n * (label - p)) - ridge * self.w
            bend = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(self.w))
            step = np.linalg.solve(bend, slope)
            self.w += step * min(1.0, 4 / (abs(step).max() + 1e-12))
            if abs(step).max() < 1e-9:
                break

    def _hot(self, trait: np.ndarray) -> np.ndarray:
        x = np.zeros((len(trait), len(self.columns)))
        for j in range(trait.shape[1]):
            for i, value in enumerate(trait[:, j]):
                c = self.columns.get((j, int(value)))
                if c is not None:
                    x[i, c] = 1
        return x

    def probability(self, trait: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._hot(trait) @ self.w, -30, 30)))


SPANS = "array<struct<start:int,kind:int,end:int,base:boolean,votes:string,traits:string>>"


def _find(name: str):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("traits", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(batch.schema.get_field_index(name)).to_pylist():
                out.append([{"start": a, "kind": k, "end": b, "base": base, "votes": ",".join(map(str, votes(t, a, k, b, base))), "traits": ",".join(map(str, traits(t, a, k, b)))} for a, k, b, base in candidates(t)] if t else [])
            keep = [i for i, f in enumerate(batch.schema) if f.name != name]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(out, kind)], names=[*[batch.schema.field(i).name for i in keep], "found"])

    return run


def train(found: DataFrame) -> frozenset:
    """Trait strings that the classifier accepts (of those that occur), at 0.5."""
    counted = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", "s.traits").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes", "traits")
    table = counted.collect()  # bounded by the numbers of votes and trait values
    if not table:
        return frozenset()
    vote = np.array([[int(x) for x in r["votes"].split(",")] for r in table])
    trait = np.array([[int(x) for x in r["traits"].split(",")] for r in table])
    count = np.array([r["n"] for r in table])
    label = fit_labels(np.array([r["kind"] for r in table]), vote, count)
    p = SpanClassifier(trait, label, count).probability(trait)
    return frozenset(r["traits"] for r, x in zip(table, p) if x >= 0.5)


def settle(spans: list[dict], accepted: frozenset) -> tuple[list[tuple], list[tuple]]:
    """(base, all) spans as (start, kind, end)."""
    base = [(s["start"], s["kind"], s["end"]) for s in spans if s["base"]]
    extra, last = [], -1
    taken = sorted((a, b) for a, _, b in base)
    ends = -1
    reach = []  # furthest end of the base spans up to each
    for _, b in taken:
        ends = max(ends, b)
        reach.append(ends)
    starts = np.array([a for a, _ in taken])
    for s in spans:
        if s["base"] or s["traits"] not in accepted or s["start"] < last:
            continue
        i = int(np.searchsorted(starts, s["end"]))  # base spans that begin before its end
        if i and reach[i - 1] > s["start"]:
            continue
        extra.append((s["start"], s["kind"], s["end"]))
        last = s["end"]
    return base, sorted(base + extra)


def _text(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _settle(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("found")
            cols: dict = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
            for spans in batch.column(i).to_pylist():
                base, every = settle(spans, shared.value)
                for k, name in enumerate(KINDS):
                    cols[f"n_{name}"].append(sum(x[1] == k for x in base))
                cols["base_sha256"].append(hashlib.sha256(_text(sorted(base)).encode()).hexdigest())
                cols["spans"].append(_text(every))
            kept = [j for j in range(batch.num_columns) if j != i]
            yield pa.RecordBatch.from_arrays([*[batch.column(j) for j in kept], *[pa.array(v, pa.string() if c in ("base_sha256", "spans") else pa.int64()) for c, v in cols.items()]], names=[*[batch.schema.field(j).name for j in kept], *cols])

    return run


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base counts of each kind, base_sha256, spans."""
    spark = docs.sparkSession
    prepare(spark)
    part = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = part.schema["doc_id"].dataType.simpleString()
    found = materialize(part.mapInArrow(_find("text"), f"doc_id {kind}, found {SPANS}"), "spans")
    accepted = spark.sparkContext.broadcast(train(found))
    return found.mapInArrow(_settle(accepted), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
