"""Personal data: base patterns, and boosted trees over further candidates.

The base finds e-mail addresses, IP addresses, card and phone numbers by fixed
patterns.  Beside it, generators with high recall propose spans that the base
does not cover (addresses written with "at" and "dot", phone numbers without a
country code, identity numbers, bank accounts, IPv6 addresses).  Proposals may
overlap.  Boosted trees score each from its format and its context; a score is
calibrated to a probability on rows held out from the fit, and per kind the
lowest threshold that reaches PRECISION there selects.  Of overlapping
selections the more probable stays.

The trees are fitted on the driver on TRAIN_ROWS labelled candidates that
``synthetic`` writes (fixed seed); their number is this documented bound.

Proposals are merged with the base spans in order, so a text's cost grows with
its length and, but for sorting, with its number of spans.

Defined results: a null or empty text has no spans; repeated rows and equal
texts have equal spans; other columns, whatever their names, are not looked at
(``redact`` also sets ``n_chars`` where there is one); offsets are code points
of the whole text, however long; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boost import BoostedTrees
from .common import id_and_text, map_texts, spread

TRAIN_ROWS = 6000
PRECISION = 0.98

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("email_spelled", "phone_local", "ssn", "iban", "ipv6")
KINDS = {k: i for i, k in enumerate(BASE_KINDS + MORE_KINDS)}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match always starts at the first digit of a run, so a run is tried once.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match holds one @ after its local part, so the text is searched from @ to @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base, by start, then kind as listed."""
    out = [(s, "email", e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
                out.append((m.start(), "ip", m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), "card", m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS[s[1]]))


_AT = r"(?:\(at\)|\[at\]|\{at\}|&#64;|\bat\b|@)"
_DOT = r"(?:\(dot\)|\[dot\]|\{dot\}|\bdot\b|\.)"
_AROUND_AT = re.compile(r"\(at\)|\[at\]|\{at\}|&#64;|\bat\b", re.IGNORECASE)
#: What sets a spelled address apart from prose; it must stand in the span itself.
_SPELLED = re.compile(r"[(\[{]at[)\]}]|&#64;|dot", re.IGNORECASE)
_BEFORE_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?\Z")
_AFTER_AT = re.compile(rf" ?[A-Za-z0-9-]{{1,63}}(?: ?{_DOT} ?[A-Za-z0-9-]{{1,63}}){{1,4}}", re.IGNORECASE)

GENERATORS = {
    "phone_local": re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,5}\)?(?:[ ./-]?[0-9]{2,5}){1,4}(?![0-9A-Za-z])"),
    "ssn": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    "ipv6": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
}


def proposals(text: str) -> list[tuple[int, str, int]]:
    """Candidate spans of the further kinds; they may overlap each other."""
    out = []
    if _DIGIT.search(text):
        for kind in ("phone_local", "ssn", "iban"):
            out += [(m.start(), kind, m.end()) for m in GENERATORS[kind].finditer(text)]
    if text.count(":") >= 2:
        out += [(m.start(), "ipv6", m.end()) for m in GENERATORS["ipv6"].finditer(text)]
    low = text.lower()
    if "dot" in low or "(at)" in low or "[at]" in low or "{at}" in low or "&#64;" in low:
        for m in _AROUND_AT.finditer(text):
            left = text[max(0, m.start() - 66) : m.start()]
            if (a := _BEFORE_AT.search(left)) and (b := _AFTER_AT.match(text, m.end())):
                start = m.start() - len(left) + a.start()
                if _SPELLED.search(text, start, b.end()):
                    out.append((start, "email_spelled", b.end()))
    return out


#: Words that announce personal data, by what they announce.
_HINTS = (
    re.compile(r"mail|contact|write|reach", re.IGNORECASE),
    re.compile(r"phone|tel|call|mobile|cell|fax|dial|whatsapp", re.IGNORECASE),
    re.compile(r"ssn|social|security|taxpayer", re.IGNORECASE),
    re.compile(r"iban|account|bank|konto", re.IGNORECASE),
    re.compile(r"\bip\b|ipv6|host|address|server", re.IGNORECASE),
    re.compile(r"order|invoice|version|isbn|page|section|room|serial|ticket|score|ratio|date|time|year|ref", re.IGNORECASE),
)
_MAX_CONTEXT = 40


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "").upper()
    try:
        return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    except ValueError:
        return False


def features(text: str, start: int, kind: str, end: int) -> list[float]:
    """Format of the span, and its context of at most 40 characters to each side."""
    span = text[start:end]
    digits = _digits(span)
    n = len(span)
    groups = re.findall(r"[0-9]+", span)
    seps = Counter(re.findall(r"[ ./:()-]", span))
    left, right = text[max(0, start - _MAX_CONTEXT) : start], text[end : end + _MAX_CONTEXT]
    counts = Counter(digits)
    entropy = -sum(c / len(digits) * math.log2(c / len(digits)) for c in counts.values()) if digits else 0.0
    hextets = span.split(":")
    return [
        float(KINDS[kind]),
        n,
        len(digits),
        sum(c.isalpha() for c in span) / n,
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(groups[-1]) if groups else 0,
        len(groups[0]) if groups else 0,
        len(seps),
        seps["-"], seps["."], seps["/"], seps[" "], seps["("], seps[":"],
        entropy,
        float(luhn(digits)) if digits else 0.0,
        float(_iban_ok(span)) if kind == "iban" else 0.0,
        float(digits[:1] == "0"),
        float(len(hextets) == 8 or "::" in span),
        max(map(len, hextets)),
        float(bool(re.search(r"(?i)[(\[{]at[)\]}]|&#64;", span))),
        float(bool(re.search(r"(?i)[(\[{]dot[)\]}]", span))),
        float(bool(re.search(r"(?i)\bdot\b", span))),
        float(bool(re.search(r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|info)\Z", span))),
        float(digits[:3] in ("000", "666") or digits[:1] == "9") if kind == "ssn" else 0.0,
        *(float(bool(h.search(left))) for h in _HINTS),
        float(left[-2:-1] in (":", "=") or left[-1:] in (":", "=")),
        float(left[-1:] in ("$", "€", "£", "#")),
        float(right[:1] in ("%", "€", "°") or right[1:3] in ("kg", "km", "cm", "mm", "USD"[:2])),
    ]


def synthetic(n: int, seed: int) -> list[tuple[str, tuple[int, str, int], int]]:
    """Labelled candidates: texts with personal data, or with what looks like it, written by rule."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def spelled():
        at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("{at}", "."), (" (at) ", " (dot) ")])
        return f"{word()}{rng.choice(['.', '_', ''])}{digits(rng.randint(0, 2))}{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'info'])}"

    def phone():
        a, b, c = rng.choice([2, 3, 4]) * "x", rng.choice("23456789") + digits(2), digits(4)
        a = rng.choice("23456789") + digits(2)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{digits(2)} {digits(3)} {digits(4)}", f"0{digits(3)}/{digits(6)[:5]}"])

    def ssn():
        return f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"

    def iban():
        country, body = rng.choice(["DE", "FR", "ES", "GB", "NL"]), digits(rng.choice([16, 18, 20]))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        raw = f"{country}{check:02d}{body}"
        return " ".join(raw[i : i + 4] for i in range(0, len(raw), 4)) if rng.random() < 0.6 else raw

    def ipv6():
        parts = [hexes(rng.randint(1, 4)) for _ in range(8)]
        return ":".join(parts) if rng.random() < 0.6 else ":".join(parts[:3]) + "::" + ":".join(parts[:2])

    def no_mail():
        return f"{word()} at {word()} dot {word()} {word()}" if rng.random() < 0.5 else f"look at {word()}. {word()} dot"

    def no_phone():
        y = rng.randint(1900, 2030)
        return rng.choice([
            f"{y}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{y}",
            f"{digits(rng.randint(4, 8))}", f"{y}-{y + 1}", f"{digits(2)}.{digits(2)}", f"{digits(2)}/{digits(2)}", f"{digits(4)} {digits(4)} {digits(4)} {digits(3)}",
            f"{digits(3)} {digits(3)} {digits(3)}", f"978-{digits(1)}{digits(1)}-{digits(5)}-{digits(3)}", f"{digits(5)}-{digits(4)}", f"{digits(2)} {digits(2)} {digits(2)}",
        ])

    def no_ssn():
        return rng.choice([f"{digits(3)} {digits(2)} {digits(4)}", f"000-{digits(2)}-{digits(4)}", f"9{digits(2)}-00-{digits(4)}"])

    def no_iban():
        return rng.choice(["AB", "XY", "DE", "SN", "ID"]) + digits(2) + "".join(rng.choice("0123456789ABCDEFGHJKLMNP") for _ in range(rng.choice([8, 12, 16, 20])))

    def no_ipv6():
        return rng.choice([f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}", f"{digits(1)}:{digits(2)}:{digits(2)}", f"{hexes(2)}:{hexes(2)}:{hexes(2)}", f"{word()[:2]}::{hexes(2)}"])

    lead = {
        "email_spelled": ["mail", "contact", "write to", "reach me"], "phone_local": ["call", "tel", "phone:", "mobile", "fax"],
        "ssn": ["ssn", "social security", "SSN:"], "iban": ["iban", "account", "bank account:"], "ipv6": ["host", "ip", "server address"],
    }
    other = ["order", "invoice no", "version", "isbn", "page", "section", "serial", "ticket", "score", "date", "time", "year", "ref", "$", "room"]
    makers = {
        "email_spelled": (spelled, no_mail), "phone_local": (phone, no_phone), "ssn": (ssn, no_ssn), "iban": (iban, no_iban), "ipv6": (ipv6, no_ipv6),
    }
    out = []
    while len(out) < n:
        kind, label = rng.choice(MORE_KINDS), rng.random() < 0.5
        thing = makers[kind][0 if label else 1]()
        cue = rng.choice(lead[kind]) if rng.random() < (0.6 if label else 0.1) else (rng.choice(other) if not label and rng.random() < 0.5 else "")
        text = f"{prose(rng.randint(2, 8))} {cue} {thing} {prose(rng.randint(1, 6))}"
        at = text.index(thing)
        for s in proposals(text):
            if s[0] < at + len(thing) and s[2] > at:
                whole = s[0] <= at and s[2] >= at + len(thing) - 1
                out.append((text, s, int(label and (s[1] == kind) and whole)))
    return out[:n]


@functools.lru_cache(maxsize=2)
def fit(rows: int = TRAIN_ROWS, seed: int = 7) -> tuple[BoostedTrees, dict[str, float]]:
    """The model and each kind's threshold; a kind that never reaches PRECISION selects nothing."""
    data = synthetic(rows, seed)
    x = np.array([features(t, *s) for t, s, _ in data], float)
    y = np.array([label for *_, label in data], float)
    third = len(data) // 3
    model = BoostedTrees().fit(x[: 2 * third], y[: 2 * third]).calibrate(x[2 * third :], y[2 * third :])
    p = model.probability(x[2 * third :])
    held_kind, held = x[2 * third :, 0], y[2 * third :]
    cut = {}
    for kind in MORE_KINDS:
        mine = held_kind == KINDS[kind]
        good = [t for t in np.unique(np.r_[0.5, p[mine]]) if t >= 0.5 and (q := mine & (p >= t)).any() and held[q].mean() >= PRECISION]
        cut[kind] = float(min(good, default=2.0))
    return model, cut


class Places:
    """Disjoint intervals in order; touching and overlapping ones are one."""

    def __init__(self, spans: list[tuple[int, str, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, _, end in spans:  # by start
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlap(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start

    def add(self, start: int, end: int) -> None:
        """Enter an interval that overlaps none."""
        i = bisect.bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def select(texts: list[str], model: BoostedTrees, cut: dict[str, float]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    out, asked, where = [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append((base, list(base)))
        held = Places(base)
        for s in proposals(text):
            if not held.overlap(s[0], s[2]):
                asked.append(features(text, *s))
                where.append((i, s))
    if asked:
        p = model.probability(np.array(asked, float))
        ranked = sorted(zip(p.tolist(), where), key=lambda x: (x[1][0], -x[0], x[1][1][0], KINDS[x[1][1][1]], x[1][1][2]))
        taken: dict[int, Places] = {}
        for prob, (i, s) in ranked:
            if prob >= cut[s[1]] and not (held := taken.setdefault(i, Places())).overlap(s[0], s[2]):
                held.add(s[0], s[2])
                out[i][1].append(s)
        for i in taken:
            out[i][1].sort(key=lambda s: (s[0], KINDS[s[1]], s[2]))
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts and digest of the base, all spans, and their number."""
    model, cut = fit()

    def rows(ids: list, texts: list) -> dict:
        found = select(texts, model, cut)
        counts = [Counter(k for _, k, _ in base) for base, _ in found]
        return {
            "doc_id": ids,
            **{f"n_{k}": [c[k] for c in counts] for k in BASE_KINDS},
            "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found],
            "spans": [joined(spans) for _, spans in found],
            "n_spans": [len(spans) for _, spans in found],
        }

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"
    return map_texts(id_and_text(docs), schema, rows)


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by its first kind in brackets."""
    out, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.split('_')[0].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with personal data in ``text`` replaced and n_chars set anew."""
    model, cut = fit()
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cleaned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(at).to_pylist()
            spans = [s for _, s in select([t or "" for t in texts], model, cut)]
            new = [redacted(t, s) if s else t for t, s in zip(texts, spans)]
            cols = [b.column(i) for i in range(b.num_columns)]
            cols[at] = pa.array(new, cols[at].type)
            if chars is not None:
                n = [len(t) if s else c for t, s, c in zip(new, spans, cols[chars].to_pylist())]
                cols[chars] = pa.array(n, cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return spread(docs).mapInArrow(cleaned, docs.schema)


query = find
