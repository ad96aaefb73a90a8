"""Operator 3: personal data by weak supervision.

Base spans follow fixed rules (email, ip, card, phone) and always stand.  Beyond
them, candidate spans get votes (yes, no, abstain) from labelers of three sorts:
patterns, word lists, and context.  Expectation-maximisation over the counts
of vote patterns in the whole corpus estimates each labeler's reliability; base
spans are known to be personal data, nothing else is.  The posteriors train a
logistic span classifier on the span's shape and surroundings.  A candidate is added as ``weak`` when the odds of the
classifier and those of its own votes under the estimated reliabilities, joined as
independent given the class, make it personal with at least ``THRESHOLD``.

Votes and shapes take few values, so the corpus is summarised by a histogram of
bounded size (votes x shapes); no span or text reaches the driver.

Defined cases: null and empty texts have no spans; a corpus without candidates
adds none; repeated rows are separate; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import text_or_empty
from .spans import gaps, union

KINDS = ("email", "ip", "card", "phone")
THRESHOLD, ROUNDS = 0.9, 60
#: Texts without a match hold neither base spans nor candidates.
NEEDED = r"[0-9@]|[\[(]at[\])]"
STEP = 512

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9(](?:(?:\) |[ ().-])?[0-9]){6,}")
_AT = re.compile(r"[\[(]at[\])]")
_SPELT = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]+)+")
_NAME = _LOCAL - frozenset("%+")

#: Words before a span that suggest personal data, or speak against it.
TRIGGERS = frozenset("""call cell contact email e-mail fax mail mobile phone tel telephone whatsapp card visa
    mastercard ssn iban account address ip telefon handy anruf karte konto adresse appeler courriel portable carte
    compte adresse telefono movil correo tarjeta cuenta direccion""".split())
AGAINST = frozenset("""version v release license licence chapter section page isbn issn doi no nr article
    figure table year since until copyright seite kapitel abschnitt page chapitre pagina capitulo""".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _emails(text: str):
    """One try for each @: the run before it, from the last match on, and a domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def _ips(text: str):
    """Four parts at a time from each chain of dotted numbers."""
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i: i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points, end exclusive."""
    out = [("email", *s) for s in _emails(text)]
    out += [("ip", *s) for s in _ips(text)]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def _spelt(text: str, start: int, end: int):
    """Addresses with a spelt-out at in text[start:end]: one try for each at."""
    done = start
    for at in _AT.finditer(text, start, end):
        last = at.start() - (text[at.start() - 1: at.start()] == " ")
        first = last
        while first > done and text[first - 1] in _NAME:
            first -= 1
        m = _SPELT.match(text, at.end(), end) if done <= first < last else None
        if m:
            done = m.end()
            yield first, done


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, is base): the base spans, and look-alikes in what they leave of the text.

    Spelt-out addresses come first, numbers are sought in the rest, so none runs on
    into a neighbouring span.
    """
    taken = union((s, e) for _, s, e in base)
    spelt = [x for gap in gaps(taken, len(text)) for x in _spelt(text, *gap)]
    numbers = [m.span() for gap in gaps(union(taken + spelt), len(text)) for m in _NUMBER.finditer(text, *gap)]
    return [(s, e, True) for _, s, e in base] + [(s, e, False) for s, e in sorted(spelt + numbers)]


def _labelers():
    """Each takes (span text, its digits, words before) and votes 1, -1 or 0."""
    def pattern(regex: str):
        p = re.compile(regex)
        return lambda s, d, w: 1 if p.fullmatch(s) else 0

    return [
        pattern(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[(]at[\])]) ?[A-Za-z0-9.() \[\]-]+"),
        pattern(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
        pattern(r"\+[0-9][ ().0-9-]+[0-9]"),
        pattern(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
        pattern(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        lambda s, d, w: (1 if luhn(d) else -1) if 16 <= len(d) <= 19 else 0,
        lambda s, d, w: 1 if 15 <= len(d) <= 19 and d.startswith(ISSUERS) else 0,
        lambda s, d, w: 1 if any(x in TRIGGERS for x in w) else 0,
        lambda s, d, w: -1 if any(x in AGAINST for x in w[-2:]) else 0,
        lambda s, d, w: -1 if re.fullmatch(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}", s) else 0,
    ]


LABELERS = _labelers()
_WORDS = re.compile(r"[^\W\d_][\w-]*|§")


def votes(text: str, start: int, end: int) -> list[int]:
    span = text[start:end]
    before = [w.lower() for w in _WORDS.findall(text[max(0, start - 40): start])][-4:]
    d = _digits(span)
    return [f(span, d, before) for f in LABELERS]


def shape(text: str, start: int, end: int) -> list[int]:
    """Features of the final classifier, each of few values, not of any labeler."""
    s = text[start:end]
    d = len(_digits(s))
    before, after = text[start - 1: start], text[end: end + 1]
    return [min(d // 2, 10), min(sum(c in " -" for c in s), 5), min(s.count("."), 4), int("@" in s),
            int(s[:1] == "+"), int(s[:1] == "("), int(not before or before.isspace()),
            int(not after or after.isspace() or after in ".,;:)"), min((end - start) // 4, 12)]


N_SHAPE = 9


def _histogram(batches):
    """(pattern, n) of one task: votes, shape and whether it is a base span."""
    seen: dict[str, int] = {}
    for b in batches:
        for text in b.column("text").to_pylist():
            if text:
                for s, e, base in candidates(text, base_spans(text)):
                    p = ",".join(map(str, [int(base), *votes(text, s, e), *shape(text, s, e)]))
                    seen[p] = seen.get(p, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()),
                                      pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])


def reliabilities(v: np.ndarray, n: np.ndarray, known: np.ndarray | None = None,
                  rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1) with counts; ``known`` ones are of the class.

    Every labeler has its own chances of each vote under both classes.  Starts
    from the majority of votes; returns (posterior of each pattern, chances
    [class, labeler, vote + 1]).
    """
    known = np.zeros(len(v), bool) if known is None else known
    post = np.where(known, 1.0, 1 / (1 + np.exp(-1.5 * v.sum(axis=1))))
    one_hot = np.stack([(v == k) for k in (-1, 0, 1)], axis=2).astype(float)
    theta = np.zeros((2, v.shape[1], 3))
    for _ in range(rounds):
        for c, p in ((0, 1 - post), (1, post)):
            theta[c] = (one_hot * (p * n)[:, None, None]).sum(axis=0) + 0.5
            theta[c] /= theta[c].sum(axis=1, keepdims=True)
        open_ = np.where(known, 0, n)  # the share is that among the spans in question
        prior = np.clip((post * open_).sum() / max(open_.sum(), 1), 0.01, 0.99)
        log = [np.log(x) + (one_hot * np.log(theta[c])).sum(axis=(1, 2)) for c, x in ((0, 1 - prior), (1, prior))]
        post = np.where(known, 1.0, 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50))))
    return post, theta


def _logit(p):
    return np.log(p) - np.log1p(-p)


def vote_odds(model: dict, v: np.ndarray) -> np.ndarray:
    """Log odds of personal data that rows of votes add to those of the class."""
    at = np.arange(v.shape[1])
    return (np.log(model["chances"][1][at, v + 1]) - np.log(model["chances"][0][at, v + 1])).sum(axis=1)


def _design(shapes: np.ndarray) -> np.ndarray:
    """One column for each value of each shape feature, and one of ones."""
    cols = [np.ones(len(shapes))]
    for i in range(N_SHAPE):
        cols += [(shapes[:, i] == k).astype(float) for k in range(13)]
    return np.stack(cols, axis=1)


def fit_spans(shapes: np.ndarray, posterior: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels, by Newton steps with a ridge."""
    x = _design(shapes)
    w = np.zeros(x.shape[1])
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - posterior)) + w
        h = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def train(docs: DataFrame, text: str = "text") -> dict | None:
    """Reliabilities and span classifier from all candidates of the corpus."""
    d = docs.select(text_or_empty(text).alias("text")).where(F.col("text").rlike(NEEDED))
    rows = d.mapInArrow(_histogram, "pattern string, n long").groupBy("pattern") \
        .agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not rows:
        return None
    m = np.array([[int(x) for x in r.pattern.split(",")] for r in rows])
    n = np.array([r.n for r in rows], float)
    v, shapes = m[:, 1: 1 + len(LABELERS)], m[:, 1 + len(LABELERS):]
    post, theta = reliabilities(v, n, m[:, 0] == 1)  # base spans stand
    return {"weights": fit_spans(shapes, post, n), "chances": theta}


def _find(model: dict | None, threshold: float):
    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP)):
                out = []
                for text in b.column("text").to_pylist():
                    base = base_spans(text) if text else []
                    more = [(s, e) for s, e, known in candidates(text, base) if not known] if text else []
                    if more and model:
                        x = _design(np.array([shape(text, s, e) for s, e in more]))
                        odds = x @ model["weights"] + vote_odds(model, np.array([votes(text, s, e) for s, e in more]))
                        more = [("weak", *se) for se, ok in zip(more, odds >= _logit(threshold), strict=True) if ok]
                    else:
                        more = []
                    told = [f"{k}:{s}:{e}" for k, s, e in base]
                    count = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    out.append((*count, len(more), hashlib.sha256(",".join(told).encode()).hexdigest(),
                                ",".join(told + [f"{k}:{s}:{e}" for k, s, e in more])))
                cols = list(zip(*out, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), *(pa.array(c, pa.int64()) for c in cols[:5]),
                     *(pa.array(c, pa.string()) for c in cols[5:])],
                    names=["key", *(f"n_{k}" for k in KINDS), "n_weak", "base_sha256", "spans"])
    return run


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """Per document: key, counts of base spans, n_weak, base_sha256, spans."""
    ship_package(docs.sparkSession)
    model = train(docs, text)
    t = text_or_empty(text)
    # Texts that cannot hold a span don't travel to Python.
    d = docs.select(F.col(key).cast("long").alias("key"), F.when(t.rlike(NEEDED), t).otherwise("").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return d.mapInArrow(_find(model, threshold), f"key long, {counts}, n_weak long, base_sha256 string, spans string") \
        .withColumnRenamed("key", key)
