"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans; boosted trees score each from its format
(digits, groups, checksums) and its context (cue words before it, neighbouring characters);
a threshold per kind, calibrated for ``PRECISION`` on examples of another grammar than the
trees learned from (other cues, distances, groups and neighbours), selects. The base
spans (email, ip, card, phone by their fixed expressions) always stay; added spans never
overlap them, and of overlapping candidates the likelier wins, ties going to the earlier
and then the longer one. The trees learn from examples written by ``examples``, a fixed
pseudo-random grammar, since no table labels personal data. Names are not proposed; a
spelled-out address has at most two dotted parts before and four after its sign, a street's name
one to three words, a phone number without separators 7 to 12 digits.

Defined cases: a null or empty text has no spans (redaction leaves it as it is); ids and
other columns may be null, repeated or of any name; an empty table gives an empty result;
offsets count code points, ends are exclusive; the base searches go on behind a match that
fails its test; a very long text is scanned whole.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearspan.llm.common import Booster, map_rows, replace_text
from nearspan.llm.secret_scan import join_spans

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "birth", "address")
PRECISION = 0.99

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
# A digit run that cannot start a match cannot start one further in either.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: The candidate generators beside the base expressions.
GENERATORS = {
    "email": re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{1,64}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z0-9_%+-]{1,64}){0,2} ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z]{2,24}){1,4}(?!\w)"),
    "phone": re.compile(r"(?<![\w.+-])(?:\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,8}){1,4}|[0-9]{7,12})(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "birth": re.compile(r"(?<![\w.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![\w-])"),
    "address": re.compile(r"(?<![\w.-])[0-9]{1,5} (?:[A-Z][a-z'-]{1,30} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square)\b"),
}

# Words that announce personal data.
CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel", "kontakt"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "anruf", "handy", "llam", "appel"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "birth": ("born", "birth", "dob", "geboren", "geburt", "nacid", "naissance"),
    "address": ("address", "live", "lives", "resid", "home", "wohn", "adress"),
    "other": ("order", "invoice", "isbn", "version", "date", "part", "no.", "page", "model", "on", "from"),
    "number": ("#", "id ", "sku", "code", "ref", "serial", "ticket", "batch", "total", "count"),
    "layout": ("table", "row ", "line ", "section", "figure", "chapter", "level", "stage"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by start, then kind as listed."""
    out = []
    at = text.find("@")
    free = 0
    while at >= 0:
        # The characters before the sign that a match may start with, no further back than the last match.
        low = at
        while low > free and _LOCAL.match(text[low - 1]):
            low -= 1
        m = _DOMAIN.match(text, at) if low < at else None
        if m:
            out.append((low, 0, "email", m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, "ip", m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, "card", m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, "phone", m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def _features(text: str, kind: str, a: int, b: int) -> list[float]:
    span, before, after = text[a:b], text[max(0, a - 32) : a].lower(), text[b : b + 12]
    digits = re.sub(r"[^0-9]", "", span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    near = {k: max((before.rfind(w) for w in words), default=-1) for k, words in CUES.items()}
    return [
        float(KINDS.index(kind)),
        len(span),
        len(digits),
        len(groups),
        groups[0] if groups else 0,
        groups[-1] if groups else 0,
        float("(" in span),
        float("-" in span),
        float("." in span),
        float(luhn(digits)) if digits else 0.0,
        float(kind == "iban" and iban_ok(span)),
        float(bool(re.search(r"[\[({]", span))),
        float(bool(re.search(r"(19|20)[0-9]{2}", span))),
        float(span.lower().count("dot") + span.count(".")),
        *[near[k] + 1.0 for k in CUES],
        float(before[-1:] in "$€£#/"),
        float(after[:1] in ("%", "/", ":")),
    ]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Every proposed span beside the base ones; they may overlap."""
    out = []
    if _DIGIT.search(text):
        out += [(k, m.start(), m.end()) for k in ("phone", "ssn", "iban", "birth", "address") for m in GENERATORS[k].finditer(text)]
    if " at " in text or "at]" in text or "at)" in text or "at}" in text:
        out += [("email", m.start(), m.end()) for m in GENERATORS["email"].finditer(text)]
    return out


def examples(n: int, seed: int, other: bool = False) -> tuple[list[tuple[str, str, int, int]], list[int]]:
    """Texts with a candidate span each, and whether it is personal data.

    ``other`` writes them another way: cues stand further off, behind other words, numbers
    fall into other groups, and lists, tables and codes stand next to them.
    """
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("er", "an", "th", "ti", "lo", "ma", "den", "es", "ou", "que")) for _ in range(r.randint(1, 4)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    prose = lambda k: " ".join(word() for _ in range(k))

    def iban(valid: bool) -> str:
        body = number(18)
        check = 98 - int(body + "131400") % 97
        return f"DE{(check if valid else (check + r.randint(1, 90)) % 97):02d}{body}"

    def one() -> tuple[str, str, str, int]:
        pick = r.randrange(23)
        between = (": ", " ", " is ") if not other else ("= ", " -> ", f" {word()} ", f" ({word()}) ", " no longer ", "\t")
        cue = lambda k: r.choice(CUES[k]) + r.choice(between)
        sep = r.choice((" ", "-", ".")) if not other else r.choice((" ", "-"))
        date = r.choice((f"{r.randint(1930, 2025)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28)}{r.choice('./')}{r.randint(1, 12)}.{r.randint(1930, 2025)}".replace("/", "."), f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1930, 2025)}"))
        street = f"{r.randint(1, 9999)} {word().capitalize()} {r.choice(('Street', 'St', 'Avenue', 'Road', 'Rd', 'Lane', 'Drive', 'Court'))}"
        if pick == 16:
            return "", f"{number(3)}-{number(3)}-{number(4)}", "phone", 1
        if pick == 17:
            return r.choice(("", cue("email"))), f"{word()} dot {word()} at {word()} dot {r.choice(('com', 'org', 'net', 'de'))}", "email", 1
        if pick == 18:
            return cue("birth"), date, "birth", 1
        if pick == 19:
            return r.choice(("", cue("other"), cue("other"))), date, "birth", 0
        if pick == 20:
            return r.choice(("", cue("address"), cue("address"), r.choice(("at ", "to ", "in ")))), street, "address", 1
        if pick == 21:
            return r.choice(CUES["layout"]).strip() + " ", street, "address", 0
        if pick == 22:
            return r.choice(("#", "id ", "sku ", "code ")), f"{number(4)}-{number(r.randint(2, 4))}-{number(4)}", "phone", 0
        if pick == 0:
            return cue("phone"), f"{number(3)}{sep}{number(3)}{sep}{number(4)}", "phone", 1
        if pick == 1:
            return r.choice(("", cue("phone"))), f"({number(3)}) {number(3)}-{number(4)}", "phone", 1
        if pick == 2:
            local = r.choice((f"0{number(r.randint(2, 4))} {number(3)} {number(4)}", f"0{number(r.randint(2, 3))} {number(r.randint(6, 8))}", number(r.randint(7, 11))))
            if r.random() < 0.6:
                return cue("phone"), local, "phone", 1
            return r.choice(("", cue("other"), r.choice(CUES["number"]) + r.choice(between))), number(r.randint(7, 12)), "phone", 0
        if pick == 3:
            if r.random() < 0.4:
                return r.choice(CUES["number"]) + r.choice(between), f"{number(3)}-{number(2)}-{number(4)}", "ssn", 0
            if r.random() < 0.4:  # the same shape, proposed as a phone number
                return r.choice(("", cue("ssn"))), f"{number(3)}-{number(2)}-{number(4)}", "phone", 0
            return cue("ssn"), f"{number(3)}-{number(2)}-{number(4)}", "ssn", 1
        if pick == 4:
            return r.choice(("", cue("iban"))), iban(True), "iban", 1
        if pick == 5:
            return r.choice(("", cue("email"))), f"{word()}.{word()} [at] {word()} [dot] com", "email", 1
        if pick == 6:
            return cue("email"), f"{word()}{number(2)} at {word()} dot {r.choice(('com', 'org', 'net'))}", "email", 1
        if pick == 7:
            if r.random() < 0.4:
                return "", f"{word()} at {word()} dot {word()}{word()}", "email", 0
            return "", f"{word()} at {word()}" + "".join(f". {r.choice((word(), word().capitalize()))}" for _ in range(r.choice((1, 1, 2, 3, 4)))), "email", 0
        if pick == 8:
            return r.choice(("", cue("other"))), f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", "phone", 0
        if pick == 9:
            return r.choice(("", cue("other"))), f"{number(4)}{sep}{number(4)}{sep}{number(4)}{sep}{number(4)}", "phone", 0
        if pick == 10:
            return r.choice(("", cue("other"))), f"{number(r.randint(2, 5))}{sep}{number(r.randint(2, 5))}", "phone", 0
        if pick == 11:
            return cue("other"), f"{number(3)}-{number(2)}-{number(4)}", "ssn", 0
        if pick == 12:
            return r.choice(("", cue("other"))), iban(False), "iban", 0
        if pick == 13:
            return r.choice(("", cue("other"))), f"978{sep}{number(2)}{sep}{number(5)}{sep}{number(3)}", "phone", 0
        if pick == 14:
            return "", f"{number(3)} {number(3)} {number(4)}", "phone", 0
        return "", f"{word()} at {word()}.{word()}", "email", 0

    spans, marks = [], []
    for _ in range(n):
        cue, span, kind, mark = one()
        head = f"{prose(r.randint(1, 8))} {cue}"
        spans.append((f"{head}{span} {prose(r.randint(1, 6))}", kind, len(head), len(head) + len(span)))
        marks.append(mark)
    return spans, marks


@lru_cache(1)
def model() -> tuple[Booster, dict[str, float]]:
    """The trees, and for each kind a probability from which on held-out precision is reached."""
    spans, marks = examples(6000, 5)
    y = np.array(marks, float)
    booster = Booster(rounds=60, depth=5).fit(np.array([_features(*s) for s in spans]), y)
    spans, marks = examples(6000, 6, other=True)
    y, p = np.array(marks), booster.probability(np.array([_features(*s) for s in spans]))
    least = {}
    for kind in {s[1] for s in spans}:
        own = np.array([s[1] == kind for s in spans])
        cuts = [c for c in np.linspace(0.02, 0.99, 98) if (chosen := own & (p >= c)).any() and y[chosen].mean() >= PRECISION]
        # As far above the least such cut as half of what costs no personal data at all.
        least[kind] = float(cuts[0] + p[own & (y == 1) & (p >= cuts[0])].min(initial=1.0)) / 2 if cuts else 1.1
    return booster, least


class SpanSet:
    """Spans that do not overlap, in order."""

    def __init__(self):
        self.starts, self.ends = [], []

    def add(self, a: int, b: int) -> bool:
        """Takes a span in, if it overlaps none."""
        at = bisect_left(self.starts, b)
        if at and self.ends[at - 1] > a:
            return False
        self.starts.insert(at, a)
        self.ends.insert(at, b)
        return True


def all_spans(text: str, learned: tuple[Booster, dict[str, float]]) -> tuple[list, list]:
    """(base spans, all spans), each by start, then kind as listed."""
    base = base_spans(text)
    booster, least = learned
    starts = [a for _, a, _ in base]
    ends = list(accumulate((b for _, _, b in base), max))
    # A span meets a base span if one of those that begin before its end reaches beyond its start.
    proposed = [c for c in candidates(text) if not (at := bisect_left(starts, c[2])) or ends[at - 1] <= c[1]]
    if not proposed:
        return base, base
    p = booster.probability(np.array([_features(text, *c) for c in proposed]))
    chosen, taken = list(base), SpanSet()
    for _, a, b, kind in sorted((-q, a, -b, k) for q, (k, a, b) in zip(p, proposed, strict=True) if q >= least.get(k, 1.1)):
        if taken.add(a, -b):
            chosen.append((kind, a, -b))
    return base, sorted(chosen, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256 and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(rows: dict) -> dict:
        out: dict = {f.name: [] for f in _SCHEMA}
        for doc_id, t in zip(rows["doc_id"], rows[text], strict=True):
            base, spans = all_spans(t or "", shared.value)
            out["doc_id"].append(doc_id)
            for k in BASE:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(join_spans(base).encode()).hexdigest())
            out["spans"].append(join_spans(spans))
        return out

    return map_rows(docs, ["doc_id", text], _SCHEMA, run)


def redacted(text: str | None, learned: tuple[Booster, dict[str, float]]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans by the first one's."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in all_spans(text, learned)[1]:
        if a >= at:
            out.append(f"{text[at:a]}[{kind.upper()}]")
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data replaced in the text; a column n_chars, where there is one, follows the text."""
    from pyspark.sql import functions as F

    shared = docs.sparkSession.sparkContext.broadcast(model())
    out = replace_text(docs, text, lambda texts: [redacted(t, shared.value) for t in texts])
    if dict(docs.dtypes).get("n_chars") == "bigint":
        out = out.withColumn("n_chars", F.length(text).cast("long"))
    return out
