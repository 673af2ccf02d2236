"""Personal data: fixed patterns, and a span classifier taught by labellers that vote without labelled data.

Labellers of three kinds (shape, gazetteer, context) vote for, against or not at all on each candidate span. Only the votes'
counts by pattern are gathered; expectation-maximisation over them estimates each labeller's reliability and each pattern's
probability, and those train a logistic classifier on the spans' own features. It decides what is added to the base spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm.common import column, rows_out, slices, table
from riskflow.session import freeze

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# A run of digits is taken whole: a match can't begin within one, nor give one back.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans by kind, then place: leftmost, not overlapping within a kind; failing matches are dropped."""
    out: list[Span] = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        # a match begins where the run of address characters before its @ begins, or where the last match ended
        begin = at
        while begin > done and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        m = DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            done = at = m.end()
        else:
            done = at = at + 1
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if p.lstrip("0") else 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


#: What a span may be beyond the base: (kind, pattern). Long runs of one class are single candidates.
CANDIDATES = (
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    # a run that fails is taken whole (group 1), or each of its digits would begin it anew
    ("number", re.compile(r"(?<![0-9A-Za-z.,+-])(?:[0-9](?:[\x20./-]?[0-9]){6,}+(?![0-9A-Za-z])|([0-9](?:[\x20./-]?[0-9])*+))")),
    ("person", re.compile(r"(?<!\w)[A-Z][a-zà-öø-ÿ]{1,20}\x20[A-Z][a-zà-öø-ÿ]{1,20}(?:\x20[A-Z][a-zà-öø-ÿ]{1,20})?(?!\w)")),
    ("address", re.compile(r"(?<!\w)[0-9]{1,5}\x20[A-Z][a-zà-öø-ÿ]{1,20}(?:\x20[A-Z][a-zà-öø-ÿ]{1,20}){1,2}(?!\w)")),
)
# Gazetteers: fixed values.
FIRST_NAMES = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
    "Anna Peter Paul Maria Hans Klaus Ursula Monika Wolfgang Petra Stefan Sabine Jean Pierre Michel Marie Nathalie Isabelle Claire Philippe Sophie "
    "Luis Carlos Carmen Ana Miguel Javier Lucia Pedro Manuel Jorge Emma Olivia Noah Liam Lucas Julia Laura Martin Daniel Alexander".split())
STREETS = frozenset("Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Square Court Way Place".split())
IBAN_COUNTRIES = frozenset("AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK".split())
NEAR = {
    "secret": re.compile(r"(?i)\b(?:token|secret|api[_-]?key|key|password|passwd|pwd|bearer|credential)s?\W{0,6}\Z"),
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta)\W{0,6}\Z"),
    "number": re.compile(r"(?i)\b(?:ssn|phone|tel|telefon|mobile|fax|passport|account|kontonummer|card|id|no|nr)\W{0,6}\Z"),
    "person": re.compile(r"(?i)\b(?:mr|mrs|ms|dr|prof|herr|frau|monsieur|madame|señor|señora|name is|signed|by|dear)\.?\W{0,3}\Z"),
    "address": re.compile(r"(?i)\b(?:address|live at|lives at|adresse|at)\W{0,4}\Z"),
}
LABELLERS = ("shape", "checksum", "gazetteer", "context", "isolation")


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """1 for, 0 against, -1 no vote, in the order of ``LABELLERS``."""
    span, before = text[start:end], text[max(0, start - 24) : start]
    digits, letters = sum(c.isdigit() for c in span), sum(c.isalpha() for c in span)
    shape, checksum, gazetteer = -1, -1, -1
    if kind == "secret":
        hexed = all(c in "0123456789abcdef" for c in span) or all(c in "0123456789ABCDEF" for c in span)
        shape = int(hexed and len(span) in (32, 40, 48, 56, 64) or (digits >= 4 and letters >= 8 and any(c.isupper() for c in span) and any(c.islower() for c in span)))
        checksum = int(len(set(span)) >= 10)
    elif kind == "iban":
        shape, checksum, gazetteer = int(15 <= len(span.replace(" ", "")) <= 34), int(_iban_ok(span)), int(span[:2] in IBAN_COUNTRIES)
    elif kind == "number":
        shape = int(bool(re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|0[0-9]{2,4}[ /-][0-9 -]{5,}", span)))
        checksum = 0 if 13 <= digits <= 19 else -1  # a card number's length without its check digit
    elif kind == "person":
        words = span.split()
        gazetteer = int(words[0] in FIRST_NAMES)
        shape = int(all(3 <= len(w) <= 12 for w in words)) - 1 if gazetteer else 0
    else:
        gazetteer = int(span.split()[-1] in STREETS)
    context = 1 if NEAR[kind].search(before) else 0 if kind in ("person", "address") else -1
    quoted = text[start - 1 : start] in ("'", '"', "=", ":", "(") or text[end : end + 1] in ("'", '"', ")")
    isolation = 1 if quoted else -1
    return shape, checksum, gazetteer, context, isolation


def features(kind: str, span: str, ballot: tuple[int, ...]) -> list[float]:
    """What the classifier sees of a span: its kind, its characters and the labellers' votes."""
    n = len(span)
    rate = lambda f: sum(map(f, span)) / n
    return [*[float(kind == k) for k, _ in CANDIDATES], min(n, 64) / 64, rate(str.isdigit), rate(str.isupper), rate(str.islower), len(set(span)) / n,
            *[float(v == 1) - float(v == 0) for v in ballot]]


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Further spans, none overlapping a base span or a candidate of an earlier kind."""
    starts, ends = _merged([(s, e) for _, s, e in base])
    out: list[Span] = []
    for kind, pattern in CANDIDATES:
        new = []
        for m in pattern.finditer(text):
            if m.lastindex:
                continue
            s, e = m.span()
            i = bisect_right(starts, s)
            if (i == 0 or ends[i - 1] <= s) and (i == len(starts) or starts[i] >= e):
                new.append((kind, s, e))
        if new:
            out += new
            starts, ends = _merged([*zip(starts, ends), *[(s, e) for _, s, e in new]])
    return out


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability that a span is personal data, by kind and votes, from ``(kind, votes, count)``.

    Dawid and Skene's model with two classes, each kind its own prior, each labeller one rate of true and one of false
    positives, started from the share of votes in favour and smoothed by one vote either way.
    """
    if not patterns:
        return {}
    kinds = sorted({k for k, _, _ in patterns})
    of = np.array([kinds.index(k) for k, _, _ in patterns])
    ballot = np.array([v for _, v, _ in patterns])
    count = np.array([c for _, _, c in patterns], dtype=float)
    yes, no = ballot == 1, ballot == 0
    q = (yes.sum(1) + 0.5) / (yes.sum(1) + no.sum(1) + 1.0)
    for _ in range(rounds):
        w = count * q
        u = count - w
        prior = np.array([(w[of == k].sum() + 1) / (count[of == k].sum() + 2) for k in range(len(kinds))])
        hit = ((w[:, None] * yes).sum(0) + 1.4) / ((w[:, None] * (yes | no)).sum(0) + 2)
        false = ((u[:, None] * yes).sum(0) + 0.6) / ((u[:, None] * (yes | no)).sum(0) + 2)
        # a labeller is at least as often right as by chance: else the classes could change places
        hit, false = np.maximum(hit, 0.5), np.minimum(false, 0.5)
        score = np.log(prior / (1 - prior))[of] + (yes * np.log(hit / false)).sum(1) + (no * np.log((1 - hit) / (1 - false))).sum(1)
        q = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
    return {(k, tuple(v)): float(p) for (k, v, _), p in zip(patterns, q)}


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


BALLOTS = pa.schema([("kind", pa.string()), ("ballot", pa.list_(pa.int32())), ("features", pa.list_(pa.float64())), ("count", pa.int64())])
BALLOTS_DDL = "kind string, ballot array<int>, features array<double>, count long"
#: Features are rounded to steps of this size where they are counted, so that equal spans meet before the shuffle.
STEP = 1 / 16


def _stepped(values: list[float]) -> tuple[float, ...]:
    return tuple(round(v / STEP) * STEP for v in values)


def teach(docs: DataFrame):
    """The classifier: (weights, intercept), or None where nothing is a candidate. All documents are counted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            found: dict[tuple, int] = {}
            for text in column(batch, "text"):
                text = text or ""
                for kind, s, e in candidates(text, base_spans(text)):
                    ballot = votes(kind, text, s, e)
                    key = (kind, ballot, _stepped(features(kind, text[s:e], ballot)))
                    found[key] = found.get(key, 0) + 1
            if found:
                yield rows_out(BALLOTS, zip(*[(*k, n) for k, n in found.items()]))

    cells = freeze(docs.select("text").mapInArrow(work, BALLOTS_DDL).groupBy("kind", "ballot", "features").agg(F.sum("count").alias("count")))
    # a vote pattern has at most 3 ** labellers values a kind, whatever the table's size
    patterns = cells.groupBy("kind", "ballot").agg(F.sum("count").alias("n")).collect()
    truth = reliabilities([(r["kind"], tuple(r["ballot"]), r["n"]) for r in patterns])
    if not truth:
        return None
    known = cells.sparkSession.createDataFrame([(k, list(v), p) for (k, v), p in sorted(truth.items())], "kind string, ballot array<int>, p double")
    soft = cells.join(known, ["kind", "ballot"])
    both = soft.select("features", (F.col("count") * F.col("p")).alias("weight"), F.lit(1.0).alias("label")).union(
        soft.select("features", (F.col("count") * (1 - F.col("p"))).alias("weight"), F.lit(0.0).alias("label")))
    rows = freeze(both.where("weight > 0").select(array_to_vector("features").alias("features"), "weight", "label"))
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(rows)
    return model.coefficients.toArray(), float(model.intercept)


FOUND = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every row of ``docs`` (``doc_id``, ``text``).

    ``spans`` lists kind:start:end, base spans first, then those the classifier adds (by kind, then place). Null and empty
    texts have none. Repeated rows each get a row; other columns are ignored. Without any candidate nothing is added. An
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(teach(docs))
    names = [k for k, _ in CANDIDATES]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text")):
                text = text or ""
                base, added = base_spans(text), []
                if shared.value is not None:
                    weights, intercept = shared.value
                    for kind, s, e in candidates(text, base):
                        x = features(kind, text[s:e], votes(kind, text, s, e))
                        if 1 / (1 + np.exp(-(float(weights @ np.array(x)) + intercept))) >= threshold:
                            added.append((kind, s, e))
                added.sort(key=lambda s: (names.index(s[0]), s[1]))
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                out.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            yield rows_out(FOUND, zip(*out) if out else [[]] * len(FOUND))

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return own.mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
