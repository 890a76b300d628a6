"""Operator 8: personal data by aggregating weak labelers.

Base spans follow fixed patterns (email, ip, card, phone) and always stay. Further candidates come from looser
patterns: keys and passwords after a cue, written-out addresses, identity and account numbers, local phone numbers.
Labelers judge every candidate, base spans too, with yes, no or no vote: a regex labeler (strict form or checksum), a
gazetteer labeler (known domains, prefixes and placeholder values), context labelers (cue words before it, what adjoins
it) and two of shape. Expectation-maximisation over the counts of all vote patterns of the corpus (at most 7 * 3^6 rows
reach the driver) estimates each labeler's reliability by class. A linear span classifier is then trained on the
posterior labels: beside the votes it sees the span itself (its kind, length, make-up and entropy) and its context (the
words before it, hashed), from at most `SAMPLES` spans of each vote pattern, those of the least hashes. A candidate that it
accepts, and that no span before it overlaps, is added.

All patterns run in time linear in the text, and overlaps are found by bisection. Null text is empty and has no spans; the
digest is then that of the empty string. Repeated rows and null ids are read row by row, texts of any length whole; an empty
table gives no rows, and other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, small_batches
from .toxicity import linear

#: Spans of each vote pattern that train the classifier, and places for the hashed words before a span.
SAMPLES, CONTEXT = 32, 32
KINDS = ("email", "ip", "card", "phone", "secret", "id", "account")
LABELERS = 6
#: Cue words before a value, top-level domains, and values that stand for none.
CUES = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "key"),
    "id": ("ssn", "social", "tax", "passport", "id"),
    "account": ("iban", "account", "bank"),
}
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
PLACEHOLDERS = ("changeme", "password", "example", "xxxxxx", "secret", "none", "null", "true", "false", "required", "string")

_LOCAL = "[A-Za-z0-9._%+-]"
# a possessive run from its start does what the plain pattern does, in linear time
_EMAIL_AT = re.compile(rf"{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_EMAIL = re.compile(rf"(?<!{_LOCAL}){_EMAIL_AT.pattern}")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\x20{0,2}[=:]\x20{0,2}[\"']?([^\s\"',;]{6,}+)")
_SPELT = re.compile(rf"(?i)(?<!{_LOCAL}){_LOCAL}++\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]{{2,}}+)++")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![\w.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])")

Span = tuple[str, int, int]


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    odd = [int(c) for c in number[::-1]]
    return sum(odd[::2] + [d * 2 - 9 * (d > 4) for d in odd[1::2]]) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while True:
        # right after a match the rest of a run may itself start an address
        found = (_EMAIL_AT.match(text, at) if at else None) or _EMAIL.search(text, at)
        if not found:
            return
        yield found.span()
        at = found.end()


def base_spans(text: str) -> list[Span]:
    """Of each kind leftmost and without overlap, in the order of KINDS, then by start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return out


def loose_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("secret", *m.span(1)) for m in _SECRET.finditer(text)]
    if re.search(r"(?i)[\[(]\x20?at\x20?[\])]", text):
        out += [("email", *m.span()) for m in _SPELT.finditer(text)]
    if re.search("[0-9]{2}", text):
        out += [("id", *m.span()) for m in _ID.finditer(text)]
        out += [("account", *m.span()) for m in _ACCOUNT.finditer(text)]
        out += [("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    return out


def _mod97(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def votes(text: str, span: Span, base: bool) -> tuple[int, ...]:
    """What each labeler says: 1 yes, -1 no, 0 nothing."""
    kind, a, b = span
    value, left, after = text[a:b], text[max(0, a - 32) : a].lower(), text[b : b + 1]
    number = digits(value)
    strict = 1 if base else {"account": lambda: 1 if _mod97(value) else -1, "id": lambda: -1 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" else 1}.get(kind, lambda: 0)()
    if kind == "email":
        known = 1 if re.split(r"[.\])\x20]", value.lower())[-1] in DOMAINS else -1
    elif kind == "secret":
        known = -1 if any(p in value.lower() for p in PLACEHOLDERS) or len(set(value)) < 4 else 0
    else:
        known = -1 if len(set(number)) < 3 else 0
    cue = 1 if any(c in left for c in CUES[kind]) else 0
    joined = -1 if (a and text[a - 1].isalnum()) or after.isalnum() or after in ("_", "/") and after else 1
    shape = (1 if entropy(value) > 2.5 and number and re.search("[A-Za-z]", value) else -1) if kind == "secret" else (1 if entropy(value) > 1.5 else -1)
    size = 1 if 7 <= len(value) <= 80 else -1
    return strict, known, cue, joined, shape, size


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def described(text: str, span: Span, pattern: tuple[int, ...]) -> np.ndarray:
    """What the classifier sees: the votes (yes, no of each labeler), the span, its context and a constant."""
    kind, a, b = span
    value, n = text[a:b], b - a
    out = np.zeros(2 * LABELERS + len(KINDS) + 6 + CONTEXT + 1)
    p = np.array(pattern)
    out[: 2 * LABELERS] = np.concatenate([p > 0, p < 0])
    out[2 * LABELERS + KINDS.index(kind)] = 1
    at = 2 * LABELERS + len(KINDS)
    letters, upper, figures = sum(map(str.isalpha, value)), sum(map(str.isupper, value)), len(digits(value))
    out[at : at + 6] = math.log1p(n) / 4, letters / n, upper / n, figures / n, (n - letters - figures) / n, entropy(value) / 4
    for word in text[max(0, a - 32) : a].lower().split()[-3:]:
        out[at + 6 + zlib.crc32(word.encode()) % CONTEXT] = 0.5
    out[-1] = 1
    return out


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of class 1 for each vote pattern (rows of -1, 0, 1), from their counts alone."""
    posterior = 1 / (1 + np.exp(-patterns.sum(1).astype(float)))
    for _ in range(rounds):
        logs = np.zeros((2, len(patterns)))
        for y, mass in ((0, counts * (1 - posterior)), (1, counts * posterior)):
            for k in range(patterns.shape[1]):
                # a weak prior keeps yes likelier in class 1 and no likelier in class 0
                seen = [mass[patterns[:, k] == v].sum() + {(-1, 0): 2, (1, 1): 2}.get((v, y), 1) for v in (-1, 0, 1)]
                logs[y] += np.log(np.array(seen) / sum(seen))[patterns[:, k] + 1]
            logs[y] += np.log(mass.sum() + 1)
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))
    return posterior


def trained(tally: list[tuple[str, int]], samples: list[tuple[str, bytes]]) -> np.ndarray | None:
    """Weights of the span classifier. tally: votes as text, their count. samples: votes, what the classifier sees of a span."""
    if not samples:
        return None
    patterns = np.array([[int(v) for v in p.split()] for p, _ in tally])
    counts = np.array([float(n) for _, n in tally])
    posterior = dict(zip((p for p, _ in tally), label_model(patterns, counts), strict=True))
    many, seen = dict(tally), Counter(p for p, _ in samples)
    x = np.array([np.frombuffer(v, np.float32) for _, v in samples], float)
    y = np.array([posterior[p] for p, _ in samples])
    weight = np.sqrt([(np.log1p(many[p]) + 1) / seen[p] for p, _ in samples])  # rare patterns count too
    return linear(x * weight[:, None], y, penalty=0.05)


def free(spans: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """The spans that overlap none of the taken ones, which are in order and apart."""
    starts, ends = [a for a, _ in taken], [b for _, b in taken]
    out = []
    for span in spans:
        i = bisect_right(ends, span[1])
        if i == len(starts) or starts[i] >= span[2]:
            out.append(span)
    return out


def apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as ordered spans without overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def accepted(text: str, base: list[Span], weights: np.ndarray | None) -> list[Span]:
    """The base spans and the candidates the classifier takes, in order."""
    out = list(base)
    found = loose_spans(text) if weights is not None else []
    while found:  # spans of one kind follow each other and do not overlap
        kind = found[0][0]
        n = next((i for i, s in enumerate(found) if s[0] != kind), len(found))
        same, found = found[:n], found[n:]
        same = [s for s in free(same, apart([(a, b) for _, a, b in out])) if described(text, s, votes(text, s, False)) @ weights > 0]
        out += same
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes, their count, and for each vote pattern and place by hash the span of the least hash as the classifier sees it."""
    n: Counter[str] = Counter()
    least: dict[tuple[str, int], tuple[int, bytes]] = {}
    for batch in by_bytes(batches):
        for text in batch.column("text").to_pylist():
            if text:
                for base, spans in ((True, base_spans(text)), (False, loose_spans(text))):
                    for span in spans:
                        pattern = votes(text, span, base)
                        name = " ".join(map(str, pattern))
                        n[name] += 1
                        h = int.from_bytes(hashlib.blake2b(text[max(0, span[1] - 32) : span[2] + 32].encode(), digest_size=6).digest(), "big")
                        place = (name, h % SAMPLES)
                        if place not in least or h < least[place][0]:
                            least[place] = h, described(text, span, pattern).astype(np.float32).tobytes()
    rows = [(v, -1, m, 0, b"") for v, m in n.items()] + [(v, k, 0, h, x) for (v, k), (h, x) in least.items()]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["votes", "place", "n", "h", "seen"])


def _found(weights: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                n = Counter(k for k, _, _ in base)
                rows.append((*(n[k] for k in KINDS[:4]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(accepted(text or "", base, weights))))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row for each row of docs."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = docs.select("text").mapInArrow(_tally, "votes string, place int, n long, h long, seen binary")
    rows = rows.groupBy("votes", "place").agg(F.sum("n").alias("n"), F.min(F.struct("h", "seen")).alias("least")).orderBy("votes", "place").collect()  # (SAMPLES + 1) * 3^6 rows at most
    weights = trained([(r.votes, r.n) for r in rows if r.place < 0], [(r.votes, bytes(r.least.seen)) for r in rows if r.place >= 0])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_found(weights), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
