"""Secret scan: pattern matches, and credential-context values that are expensive to guess.

Values that follow a credential word are priced with a dynamic programme: the cheapest way to spell the
value out of known words, dates, repeats, keyboard walks and sequences, and brute-force characters. A
value whose price reaches the limit is a secret even where no pattern knows its form.

Cases: NULL and empty texts have no spans; a text of any length is searched whole; repeated rows are
answered row by row; other columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, functions as F

from attestra.llm.common import per_text

# Base patterns and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "guess")

# A credential word, also as a part of a name joined by "_", and what leads from its end to the value. The value is
# not part of the word's match, so it may itself be a credential word that leads to the next value.
CONTEXT = (r"(?i:(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_\s-]?key|credentials?"
           r"|auth(?:orization)?|bearer|private[_\s-]?key|access[_\s-]?key)(?![A-Za-z0-9])(?:_[A-Za-z0-9]+)*+"
           r"(?:[\s-]++key(?![A-Za-z0-9]))*+)")
VALUE = (r"""["']?(?:\s*+[:=]++>?+\s*+|\s++(?:(?i:is|was|est|ist|es)(?:\s*+[:=]++>?+\s*+|\s++))?+)"""
         r"""["']?([^\s"'<>,;]+)""")
WORDS = """password passwd pass secret token key admin root user login welcome letmein qwerty dragon monkey
master shadow sunshine princess football baseball superman batman iloveyou trustno access hello freedom
whatever starwars computer michael jennifer jordan hunter soccer summer winter spring autumn love money
server database test example sample demo changeme default temp guest public private internet service
system office company january february march april june july august september october november december
monday tuesday wednesday thursday friday saturday sunday none null true false your here insert value
placeholder undefined string required policy reset manager protected field""".split()
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"
                  r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
_CONTEXT, _VALUE = re.compile(CONTEXT, re.ASCII), re.compile(VALUE, re.ASCII)
ANY_WORD = math.log10(50_000)
JOIN = math.log10(2)


def _key_places() -> dict[str, tuple[float, int]]:
    return {c: (x + 0.4 * y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}


def repeats(value: str, i: int) -> list[tuple[int, int]]:
    """(length, times) of the blocks that are repeated from ``i`` on; multiples inside a repeat are left to it."""
    out, least = [], 2
    while 2 * least <= len(value) - i:
        m = re.compile(r"(.{%d,}?)\1+" % least, re.S).match(value, i)
        if not m:
            break
        size = len(m.group(1))
        out.append((size, len(m.group()) // size))
        least = len(m.group()) // 2 + 1
    return out


def log10_guesses(value: str, words: tuple[str, ...] = tuple(WORDS), enough: float = math.inf) -> float:
    """Price of the cheapest segmentation of ``value``, as a power of ten; from ``enough`` on not the least."""
    n = len(value)
    rank = {w: i + 1 for i, w in enumerate(words)}
    longest = max(map(len, rank), default=0)
    low = value.lower() if len(value.lower()) == n else value
    plain = "".join(LEET.get(c, c) for c in low)
    places = _key_places()
    dates: dict[int, list[int]] = {}
    for m in (DATE.match(value, i) for i in range(n)):
        if m:
            dates.setdefault(m.start(), []).append(m.end())

    def character(c: str) -> float:
        return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)

    best = [0.0] + [math.inf] * n

    def offer(i: int, j: int, price: float) -> None:
        best[j] = min(best[j], best[i] + price + (JOIN if i else 0.0))

    again: dict[int, list[tuple[int, int]]] = {}    # by the end of a first block: what repeats it
    alike = step = walk = 0                     # starts of the runs that end at the current character
    for i in range(n):
        for size, times in again.pop(i, ()):    # a repeated block costs its block
            for t in range(2, times + 1):
                offer(i, i + size * (t - 1), math.log10(t))
        if best[i] < enough:                    # no way through a dearer place is cheaper
            for size, times in repeats(value, i):
                again.setdefault(i + size, []).append((size, times))
        best[i + 1] = min(best[i + 1], best[i] + character(value[i]))
        for j in range(i + 3, min(n, i + longest) + 1):
            for text, extra in ((low[i:j], 0.0), (plain[i:j], 1.0)):
                if text in rank:
                    shape = 0.0 if value[i:j] == low[i:j] else 0.7
                    offer(i, j, math.log10(rank[text] + 1) + extra + shape)
                    break
        for j in dates.get(i, ()):
            offer(i, j, 2.1 if j - i == 4 else 4.6)
        if i:
            if value[i] != value[i - 1]:
                alike = i
            move = ord(value[i]) - ord(value[i - 1])
            if abs(move) != 1 or (i - step > 1 and move != ord(value[i - 1]) - ord(value[i - 2])):
                step = i if abs(move) != 1 else i - 1
            a, b = places.get(low[i - 1]), places.get(low[i])
            if not (a and b and abs(a[0] - b[0]) <= 1.4 and abs(a[1] - b[1]) <= 1):
                walk = i
        if i - alike >= 2:
            offer(alike, i + 1, character(value[i]) + math.log10(i - alike + 1))
        if i - step >= 2:
            offer(step, i + 1, character(value[i]) + math.log10(2 * (i - step + 1)))
        if i - walk >= 3:
            offer(walk, i + 1, math.log10(47) + 0.15 * (i - walk))
    if value.isalpha() and value[1:] in (value[1:].lower(), value[1:].upper()):
        best[n] = min(best[n], ANY_WORD)        # one natural word of any language, not a key
    return best[n]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Contract matches per kind: leftmost, non-overlapping, too short ones dropped."""
    spans = []
    lowered = text.lower()
    if "pass" in lowered or "secret" in lowered or "token" in lowered or "key" in lowered or not text.isascii():
        spans += [("assign", *m.span()) for m in re.finditer(ASSIGN, text, re.ASCII)
                  if len(m.group(2)) >= LEAST["assign"]]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in re.finditer(ACCESS, text) if len(m.group()) >= LEAST["access"]]
    # a maximal run of 24 or more: the same as every run, short ones dropped
    spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]{%d,}" % LEAST["hex"], text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def guess_spans(text: str, base: list[tuple[str, int, int]], limit: float) -> list[tuple[str, int, int]]:
    """Values in a credential context, not inside base spans, that cost 10**limit guesses or more."""
    found = set()
    for word in _CONTEXT.finditer(text):
        m = _VALUE.match(text, word.end())
        if m:
            value = m.group(1).rstrip(".!?)]}*#&%$|:")
            if len(value) >= 6:
                found.add((m.start(1), m.start(1) + len(value)))
    out = []
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        at = start                              # base spans and an earlier value may hold all of it
        for _, a, b in base:
            at = max(at, b) if a <= at else at
        if at < end and not (out and end <= out[-1][2]) and log10_guesses(text[start:end], enough=limit) >= limit:
            out.append(("guess", start, end))
    return out


def secret_spans(docs: DataFrame, text: str = "text", carry: list[str] | None = None,
                 limit: float = 10.0) -> DataFrame:
    """Every document row (as struct ``doc``) with its base spans and all spans, in order of position."""
    span = "array<struct<kind:string,start:int,end:int>>"

    def answer(texts):
        rows = []
        for t in texts:
            base = base_spans(t or "")
            every = sorted(base + guess_spans(t or "", base, limit), key=lambda s: (s[1], KINDS.index(s[0])))
            rows.append(tuple([{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in (base, every)))
        return rows

    return per_text(docs, text, carry or ["doc_id"], answer, f"base {span}, spans {span}")


def redact(text: str | None, spans: list, mark: str) -> str | None:
    """``text`` with every span, overlapping ones merged, replaced by ``mark``."""
    if text is None or not spans:
        return text
    parts, at = [], 0
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if s >= at:
            parts += [text[at:s], mark]
        at = max(at, e)
    return "".join(parts) + text[at:]


def without_secrets(docs: DataFrame, text: str = "text", limit: float = 10.0, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every secret in ``text`` replaced; texts without one are unchanged."""
    def answer(texts):
        rows = []
        for t in texts:
            base = base_spans(t or "")
            spans = base + guess_spans(t or "", base, limit)
            rows.append((redact(t, [{"start": a, "end": b} for _, a, b in spans], mark), bool(spans)))
        return rows

    names = docs.columns
    found = per_text(docs, text, names, answer, "clean string, hit boolean")
    return found.select(*[F.when(F.col("hit"), F.col("clean")).otherwise(F.col(f"doc.`{c}`")).alias(c) if c == text
                          else F.col(f"doc.`{c}`") for c in names])


def joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
