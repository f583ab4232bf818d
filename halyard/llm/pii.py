"""Personal data by weak supervision.

Base spans (email, ip, card, phone) come from fixed rules and always stay. Wider rules
propose more candidates. Four labelers (a regex for the strict layout, gazetteers of issuer
ranges, calling codes and top-level domains, cue words around the span, the span's own
arithmetic) vote yes, no or nothing on each mention: on base spans, whose answer is known to
be yes, on mentions that are part of a longer identifier, whose answer is known to be no, and
on candidates, whose answer is unknown. The mentions of all documents are counted by pattern
(kind, answer, votes, features); expectation-maximisation over that table, with the known
answers held fixed, estimates each labeler's reliability and each pattern's posterior. A
logistic classifier over the votes and the span's features is trained on the posteriors and
adds the candidates that it accepts.

The pattern table is a product of few-valued columns, so its size doesn't grow with the
documents. Null and empty texts have no spans; very long texts are read whole, in time near
to linear; spans that tie are sorted by start, kind, end; repeated rows repeat their results;
further columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import blocks, settle, through

#: Base kinds in the order that breaks ties.
KINDS = ["email", "ip", "card", "phone"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can't start inside a run of digits: the run's first digit would do as well
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain.domain, found from each @ on: a match
    starts where the run of local characters before its @ starts."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            floor = m.end()
            yield start, floor
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # zeros in front are cut off first: int() refuses thousands of digits
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) < 4 and int(p or "0") <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = re.sub("[^0-9]", "", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Wider rules that propose candidates; what touches a letter, a digit or an underscore is kept as a counterexample.
_WIDER = [
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9]{1,10}){1,4}")),
    (2, re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
]
_AT = re.compile(r"@|\(at\)|\[at\]")
_LONG = re.compile(r"[0-9]{4}[ .-]?[0-9]{4}|[0-9]{3}[ .-][0-9]{4}")
#: Issuer ranges with their numbers of digits, top-level domains in wide use, country calling codes.
ISSUERS = [
    ("34", 15), ("37", 15), ("4", 13), ("4", 16), ("4", 19), ("51", 16), ("52", 16), ("53", 16), ("54", 16), ("55", 16), ("222", 16), ("223", 16), ("224", 16),
    ("225", 16), ("226", 16), ("227", 16), ("23", 16), ("24", 16), ("25", 16), ("26", 16), ("270", 16), ("271", 16), ("2720", 16), ("6011", 16), ("644", 16),
    ("645", 16), ("646", 16), ("647", 16), ("648", 16), ("649", 16), ("65", 16), ("300", 14), ("301", 14), ("302", 14), ("303", 14), ("304", 14), ("305", 14),
    ("36", 14), ("38", 14), ("39", 14), ("3528", 16), ("353", 16), ("354", 16), ("355", 16), ("356", 16), ("357", 16), ("358", 16), ("62", 16), ("62", 19),
]
DOMAINS = set(
    "com org net edu gov mil int info biz name pro io ai app dev me tv cc co eu uk de fr es it nl be at ch se no dk fi pl cz sk hu ro bg gr pt ie lu "
    "ru ua tr il in cn jp kr tw hk sg my th vn id ph au nz za eg ng ke ma br ar cl mx pe us ca".split()
)
CALLING = set(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "212 213 216 218 220 221 234 254 255 256 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 420 421 852 853 880 886 961 962 966 971 972".split()
)
#: Words that speak for or against a kind.
CUES = {
    0: re.compile(r"mail|contact|write|correo|adresse|kontakt|schreib", re.I),
    2: re.compile(r"card|visa|credit|karte|carte|tarjeta|amex|master", re.I),
    3: re.compile(r"phone|call|tel|fax|mobile|mobil|cell|anruf|llam|appel", re.I),
}
AGAINST = re.compile(r"isbn|order|serial|version|invoice|part no|sku|id[:=#]|token|hash|key", re.I)
LABELERS = ["format", "gazetteer", "context", "arithmetic"]
#: Features beside the votes: characters before and after, separators inside, digits or letters in the span.
FEATURES = ["before", "after", "inside", "size"]
#: Values that a feature takes: 0 .. N_VALUES - 1.
N_VALUES = 4
#: Answers in the pattern table.
YES, NO, UNKNOWN = 1, 0, -1


def votes(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """One vote of each labeler: 1 yes, 0 no, -1 nothing."""
    span = text[start:end]
    digits = re.sub("[^0-9]", "", span)
    before, after = text[max(0, start - 30) : start], text[end : end + 12]
    if kind == 0:
        local, _, domain = span.partition("@")
        last = re.split(r"[^A-Za-z0-9]+", span.rstrip(")]"))[-1].lower()
        form = 0 if " " in span and "@" in span else 1 if domain else -1
        known = 1 if last in DOMAINS else -1 if last.isalpha() and len(last) > 1 else 0
        right = 0 if ".." in span or local[:1] in ".%+-" else 1 if any(c.isalpha() for c in last) else 0
    elif kind == 2:
        form = 1 if 14 <= len(digits) <= 19 else -1 if len(digits) == 13 else 0
        known = int(any(len(digits) == n and digits.startswith(p) for p, n in ISSUERS))
        right = int(luhn(digits))
    else:
        form = 1 if span.startswith("+") and 10 <= len(digits) <= 15 else -1 if 10 <= len(digits) <= 15 else 0
        if span.startswith("+"):
            known = int(any(digits.startswith(c) for c in (digits[:1], digits[:2], digits[:3]) if c in CALLING))
        else:
            known = int(digits[:1] not in ("0", "1"))
        right = 0 if len(set(digits[-10:])) < 3 else -1
    cue = 0 if AGAINST.search(before) else 1 if CUES[kind].search(before) or CUES[kind].search(after) else -1
    return form, known, cue, right


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c in ".,;:!?)]}'\"" else 2 if not (c.isalnum() or c == "_") else 3


def features(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """One value of each of FEATURES."""
    span = text[start:end]
    n = sum(c.isdigit() for c in span)
    inside = sum((" " in span, "-" in span or "." in span, "(" in span or "[" in span))
    size = min(3, n // 4 if kind == 0 else 0 if n < 10 else 1 if n < 13 else 2 if n < 17 else 3)
    return _side(text[start - 1 : start] if start else ""), _side(text[end : end + 1]), inside, size


def glued(text: str, start: int, end: int) -> bool:
    """The span is a part of a longer identifier."""
    return _side(text[start - 1 : start] if start else "") == 3 or _side(text[end : end + 1]) == 3


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of the spans, both ascending."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the wider rules that overlap no base span and no span of a rule before."""
    out: list[tuple[int, int, int]] = []
    for kind, pattern in _WIDER:
        if not (_AT if kind == 0 else _LONG).search(text):
            continue
        starts, ends = _merged([(a, b) for a, _, b in base] + [(a, b) for a, _, b in out])
        for m in pattern.finditer(text):
            a, b = m.span()
            # the last taken span that starts before this one's end is the only one that can reach it
            k = bisect_left(starts, b) - 1
            if k < 0 or ends[k] <= a:
                out.append((a, kind, b))
    return sorted(out)


def estimate(patterns: list[tuple[int, int, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict, dict]:
    """EM over (kind, answer, votes, count): posterior of each (kind, votes) whose answer is
    unknown, and each kind's labeler reliabilities (share of right votes among real and among
    other mentions). Known answers stay as they are."""
    posterior, reliability = {}, {}
    for kind in sorted({k for k, *_ in patterns}):
        own = [(a, v, n) for k, a, v, n in patterns if k == kind]
        answer = np.array([a for a, _, _ in own])
        v = np.array([x for _, x, _ in own])
        n = np.array([float(c) for _, _, c in own])
        said, yes, free = v >= 0, v == 1, answer == UNKNOWN
        # majority vote to begin with
        p = np.clip((yes.sum(1) + 0.5) / (said.sum(1) + 1), 0.05, 0.95)
        p = np.where(free, p, answer)
        for _ in range(rounds):
            # the prior is that of the candidates: known answers say nothing of it
            prior = np.clip(((n * p)[free].sum() + 1) / (n[free].sum() + 2), 0.01, 0.99)
            # pseudo-counts for a labeler that is right four times in five
            a = (((n * p)[:, None] * yes).sum(0) + 4) / (((n * p)[:, None] * said).sum(0) + 5)
            b = (((n * (1 - p))[:, None] * (said & ~yes)).sum(0) + 4) / (((n * (1 - p))[:, None] * said).sum(0) + 5)
            a, b = np.clip(a, 0.01, 0.99), np.clip(b, 0.01, 0.99)
            up = np.log(prior) + np.where(said, np.where(yes, np.log(a), np.log(1 - a)), 0).sum(1)
            down = np.log(1 - prior) + np.where(said, np.where(yes, np.log(1 - b), np.log(b)), 0).sum(1)
            p = np.where(free, 1 / (1 + np.exp(np.clip(down - up, -50, 50))), answer)
        reliability[kind] = {name: (float(a[i]), float(b[i])) for i, name in enumerate(LABELERS)}
        posterior |= {(kind, x): float(q) for (_, x, _), q, f in zip(own, p, free) if f}
    return posterior, reliability


def _row(kind: int, v: tuple[int, ...], f: tuple[int, ...]) -> np.ndarray:
    """The classifier's inputs: a constant, the votes and the features, apart for each kind."""
    width = 1 + 2 * len(LABELERS) + N_VALUES * len(FEATURES)
    x = np.zeros(len(KINDS) * width)
    at = kind * width
    x[at] = 1
    for i, vote in enumerate(v):
        if vote >= 0:
            x[at + 1 + 2 * i + vote] = 1
    for i, value in enumerate(f):
        x[at + 1 + 2 * len(LABELERS) + N_VALUES * i + value] = 1
    return x


def train(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of the span classifier: logistic regression on the posteriors, by Newton steps
    with a small ridge."""
    n = n / n.sum() * len(n)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + 0.01 * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def mentions(text: str) -> tuple[list[list[int]], list[list[int]]]:
    """Base spans and other mentions: start, kind, end, answer, votes, features; a base ip has the first three only."""
    base = base_spans(text)

    def row(a: int, k: int, b: int, answer: int) -> list[int]:
        return [a, k, b, answer, *votes(text, k, a, b), *features(text, k, a, b)]

    known = [row(a, k, b, YES) if k in CUES else [a, k, b] for a, k, b in base]
    return known, [row(a, k, b, NO if glued(text, a, b) else UNKNOWN) for a, k, b in candidates(text, base)]


def extract(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, base and more: arrays of mentions. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.int32()))
        for block in blocks(batches, "text"):
            found = [mentions(t or "") for t in block.column(1).to_pylist()]
            columns = [block.column(0), pa.array([x for x, _ in found], kind), pa.array([x for _, x in found], kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "more"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.transform(through, run, "doc_id long, base array<array<int>>, more array<array<int>>")


def learn(found: DataFrame) -> tuple[dict, dict]:
    """({(kind, votes, features): probability} of all candidates, labeler reliabilities). The
    driver gets one row for each pattern that occurs."""
    votes_of, features_of = F.slice("m", 5, len(LABELERS)), F.slice("m", 5 + len(LABELERS), len(FEATURES))
    rows = found.select(F.explode(F.concat("base", "more")).alias("m")).filter(F.size("m") > 3)
    counted = rows.groupBy(F.col("m")[1].alias("kind"), F.col("m")[3].alias("answer"), votes_of.alias("votes"), features_of.alias("features")).count().collect()
    patterns = sorted((r["kind"], r["answer"], tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in counted)
    if not any(a == UNKNOWN for _, a, *_ in patterns):
        return {}, {}
    by_votes: dict[tuple, int] = {}
    for k, a, v, _, n in patterns:
        by_votes[k, a, v] = by_votes.get((k, a, v), 0) + n
    posterior, reliability = estimate([(*key, n) for key, n in sorted(by_votes.items())])
    y = np.array([posterior[k, v] if a == UNKNOWN else a for k, a, v, _, _ in patterns], float)
    x = np.array([_row(k, v, f) for k, _, v, f, _ in patterns])
    w = train(x, y, np.array([float(p[-1]) for p in patterns]))
    scored = {(k, v, f): float(1 / (1 + np.exp(-_row(k, v, f) @ w))) for k, a, v, f, _ in patterns if a == UNKNOWN}
    return scored, reliability


def find(docs: DataFrame, text: str = "text", id_column: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """doc_id, spans array<struct<start,kind,end,added>> for every row of docs."""
    found = settle(extract(docs, text, id_column))
    scored, _ = learn(found)
    accepted = [F.array(*[F.lit(x) for x in (k, UNKNOWN, *v, *f)]) for (k, v, f), p in sorted(scored.items()) if p >= threshold]
    accepted = F.array(*accepted) if accepted else F.array().cast("array<array<int>>")

    def span(added: bool):
        return lambda s: F.struct(s[0].alias("start"), s[1].alias("kind"), s[2].alias("end"), F.lit(added).alias("added"))

    kept = F.filter("more", lambda m: F.array_contains(accepted, F.concat(F.slice(m, 2, 1), F.slice(m, 4, 1 + len(LABELERS) + len(FEATURES)))))
    return found.select(
        "doc_id", F.sort_array(F.concat(F.transform("base", span(False)), F.transform(kept, span(True)))).alias("spans")
    )


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def _listed(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def report(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: ~s["added"])
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
