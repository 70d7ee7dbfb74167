"""Secret scans: an Aho-Corasick prefilter, anchored expressions near its hits, checksums.

One automaton finds all keywords in one pass over a text; only around a hit does a regular
expression anchored there run. Tokens that embed a checksum (crc32 in base 62, a decodable
header) must pass it. The base kinds are assign, access and hex; the method's own kinds
are listed in ``OWN``.

Defined cases: a null or empty text has no spans; ids may be null or repeated, each row is
scanned on its own; offsets count code points, ends are exclusive; a base match that fails
its length test is dropped, and the search goes on behind it; a very long text is scanned
whole, in time that grows with its length; an empty table gives an empty result; other columns,
of any name, are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearspan.llm.common import map_rows

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "slack", "google", "stripe", "private_key")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_JSON, _NAME = json.JSONDecoder(), re.compile(r'\{\s*"[^"\x00-\x1f]*"\s*:')
_WORD = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

# Prefixes and shapes that the issuers publish.
OWN = {
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")),
    "npm": (("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")),
    "jwt": (("eyJ",), re.compile(r"\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}")),  # what follows the first part
    "slack": (("xoxb-", "xoxp-", "xoxa-", "xoxr-"), re.compile(r"xox[bpar]-[0-9]{8,}-[A-Za-z0-9-]{16,}")),
    "google": (("AIza",), re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])")),
    "stripe": (("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[A-Za-z0-9]{24,}")),
    "private_key": (("-----BEGIN",), re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}-----END [A-Z ]*PRIVATE KEY-----")),
}


def _base62(n: int, width: int) -> str:
    out = ""
    while n or len(out) < width:
        n, r = divmod(n, 62)
        out = _WORD[r] + out
    return out


def checksum_ok(kind: str, token: str) -> bool:
    """The checksum a token embeds; True for kinds that embed none."""
    if kind in ("github", "npm"):
        body, check = token[4:-6], token[-6:]
        return _base62(zlib.crc32(body.encode()), 6) == check
    return True


class TokenRun:
    """The tokens of three parts whose first part ends where one run of its characters does.

    Where that is, and whether the other parts follow, is found once for all starts in the run;
    headers are decoded once for each place a start may have within four characters.
    """

    RUN = re.compile(r"[A-Za-z0-9_-]*")

    def __init__(self, text: str, start: int):
        self.text, self.stop = text, self.RUN.match(text, start).end()
        rest = OWN["jwt"][1].match(text, self.stop)
        self.end, self.decoded = rest.end() if rest else None, {}

    def ends_at(self, start: int) -> int | None:
        """The end of the token that begins here, if its header is an object that names an algorithm."""
        if self.end is None or self.stop - start < 11:
            return None
        at = (self.stop - start) % 4
        if at not in self.decoded:
            head = self.text[start : self.stop]
            try:
                # A character for each byte, so that places can be reckoned.
                self.decoded[at] = start, base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)).decode("latin-1").rstrip()
            except (binascii.Error, ValueError):
                self.decoded[at] = start, ""
        first, header = self.decoded[at]
        begin = (start - first) // 4 * 3
        # An object ends in a brace and begins with a name; most starts in a run fail here, before anything is parsed.
        if not header.endswith("}") or not _NAME.match(header, begin):
            return None
        try:
            made, stop = _JSON.raw_decode(header, begin)
        except (ValueError, RecursionError):
            return None
        return self.end if isinstance(made, dict) and "alg" in made and stop == len(header) else None


class Scanner:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            self._add(word, "assign")
        self._add("akia", "access")
        for kind, (prefixes, _) in OWN.items():
            for p in prefixes:
                self._add(p.lower(), kind)
        self.automaton.make_automaton()
        self.lower = {c: c + 32 for c in range(65, 91)}

    def _add(self, word: str, kind: str) -> None:
        self.automaton.add_word(word, (len(word), kind))

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """All spans by start, then kind as listed."""
        if not text:
            return []
        found: list[tuple[int, int, str, int]] = []
        # Lower-casing A-Z alone keeps offsets; the full mapping may change lengths.
        low = text.lower() if text.isascii() else text.translate(self.lower)
        ends, run = dict.fromkeys(KINDS, 0), None
        hits = sorted((end - n + 1, kind) for end, (n, kind) in self.automaton.iter(low))
        for start, kind in hits:
            if start < ends[kind]:
                continue
            if kind == "assign":
                m = _ASSIGN.match(text, start)
                if m:
                    ends[kind] = m.end()
                    if m.end(2) - m.start(2) >= 6:
                        found.append((start, 0, kind, m.end()))
            elif kind == "access":
                m = _ACCESS.match(text, start)
                if m:
                    ends[kind] = m.end()
                    if m.end() - start >= 20:
                        found.append((start, 1, kind, m.end()))
            elif kind == "jwt":
                if text.startswith("eyJ", start):
                    if run is None or start >= run.stop:
                        run = TokenRun(text, start)
                    end = run.ends_at(start)
                    if end:
                        ends[kind] = end
                        found.append((start, KINDS.index(kind), kind, end))
            else:
                m = OWN[kind][1].match(text, start)
                if m and checksum_ok(kind, m[0]):
                    ends[kind] = m.end()
                    found.append((start, KINDS.index(kind), kind, m.end()))
        found += [(m.start(), 2, "hex", m.end()) for m in _HEX.finditer(text)]
        return [(kind, start, end) for start, _, kind, end in sorted(found)]


_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)
_SCANNER: list[Scanner] = []


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256 and all spans."""

    def run(rows: dict) -> dict:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        out: dict = {f.name: [] for f in _SCHEMA}
        for doc_id, t in zip(rows["doc_id"], rows[text], strict=True):
            spans = _SCANNER[0].spans(t)
            base = [s for s in spans if s[0] in KINDS[:3]]
            out["doc_id"].append(doc_id)
            for k in KINDS[:3]:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(join_spans(base).encode()).hexdigest())
            out["spans"].append(join_spans(spans))
        return out

    return map_rows(docs, ["doc_id", text], _SCHEMA, run)
