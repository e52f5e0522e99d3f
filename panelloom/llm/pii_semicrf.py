"""Personal data: four exact base patterns, and a semi-Markov conditional random field that adds spans.

The base patterns are those of the contract, found by linear scans: an e-mail by
walking left from each ``@``, an address from chains of dotted numbers, cards by
the Luhn sum, phones from each ``+``.

The field segments the surroundings of *triggers* (digits, ``@``, bracketed
``at``) into entities of at most ``LONGEST`` tokens and single other tokens.  A
candidate segment is scored as a whole: shape, digit count, length, checksum,
cue words before it and the characters at its edges.  Weights are trained on
generated labelled sentences by the exact gradient (forward and backward sums
over all segmentations); decoding takes the best segmentation, which chooses
boundaries and types together.  Entities without a trigger do not exist in the
model, so the rest of a text needs no work.  Candidates that overlap a base span
are not allowed: base spans stay.  Candidates that cannot beat single other tokens
in any surroundings are left out before decoding, so its time is linear in the text.

Offsets are code points, ends exclusive.  Null and empty texts have no spans;
one output row per input row.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mix, prefix, spans

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LONGEST, REACH, BUCKETS = 16, 60, 1 << 14
WINDOW, GROUP = 20_000, 200_000

Span = tuple[int, int, str]

# ---------------------------------------------------------------- base patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            yield lo, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """All base spans, by start and then kind."""
    out: list[Span] = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            for m in _DOTTED.finditer(text):
                parts, at = m.group().split("."), m.start()
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    size = sum(map(len, four)) + 3
                    if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in four):
                        out.append((at, at + size, "ip"))
                    at += size + 1
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---------------------------------------------------------------- the field

_SAID_AT = re.compile(r"[\[({]at[\])}]")
_SAID_DOT = re.compile(r"[\[({]dot[\])}]")
_TRIGGER = re.compile(r"[0-9@]|[\[({]at[\])}]")
_TOKEN = re.compile(r"[^\W_]+|\s+|.", re.S)
_RUN = re.compile(r"[^\W_]")
CUES = {
    "secret": "password passwd pwd pass secret token key apikey api_key auth bearer credential",
    "phone": "tel phone call fax mobile cell telefon telefono ring dial",
    "email": "mail email contact write reach courriel correo",
    "card": "card visa mastercard amex credit debit karte tarjeta carte",
    "ip": "ip host server address addr ping",
}
_CUE = {w: KINDS.index(kind) + 1 for kind, ws in CUES.items() for w in ws.split()}
_BARRIER = "\x00"


def _before(*columns: np.ndarray) -> list[np.ndarray]:
    """Running sums: entry i counts what lies before i."""
    return [np.concatenate([[0], np.cumsum(c, dtype=np.int64)]) for c in columns]


@lru_cache(100_000)
def _shape(token: str) -> int:
    """A number for the form of a token: its runs of digits, small and capital letters."""
    return zlib.crc32(re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "_" if c.isspace() else c for c in token)).encode())


class Zone:
    """Tokens of some stretches of text, laid end to end between barriers, and the candidates among them.

    A candidate is a range of at most ``LONGEST`` tokens that holds a trigger, has no
    white space at its ends, and is clear of barriers and of the taken spans.
    """

    def __init__(self, parts: list[str], taken: list[list[tuple[int, int]]] | None = None):
        self.text = text = _BARRIER.join(["", *parts, ""])
        self.first = np.cumsum([1] + [len(p) + 1 for p in parts])  # where each part begins
        spans = [m.span() for m in _TOKEN.finditer(text)]
        self.start, self.end = (np.array(x, np.int64) for x in zip(*spans, strict=True))
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds, of = np.unique(cps, return_inverse=True)
        alnum, space = (np.array([f(chr(k)) for k in kinds], bool)[of] for f in (str.isalnum, str.isspace))
        digit = (cps >= 48) & (cps <= 57)
        at, dot, trigger = (np.zeros(len(cps), np.int64) for _ in range(3))
        at[[m.start() for m in _SAID_AT.finditer(text)]] = 1
        dot[[m.start() for m in _SAID_DOT.finditer(text)]] = 1
        trigger[[m.start() for m in _TRIGGER.finditer(text)]] = 1
        busy = np.zeros(len(cps) + 1, np.int64)
        for lo, spans in zip(self.first, taken or [], strict=False):
            for x, y in spans:
                busy[lo + max(0, x)] += 1
                busy[lo + y] -= 1
        busy = (np.cumsum(busy)[:-1] > 0).astype(np.int64)
        barrier = np.zeros(len(cps), np.int64)
        barrier[np.r_[0, self.first[1:] - 1]] = 1
        self.sums = dict(zip(("digit", "alnum", "space", "mail", "point", "dash", "at", "dot"), _before(digit, alnum, space, cps == 64, cps == 46, cps == 45, at, dot), strict=True))
        trigger, busy, barrier = _before(trigger, busy, barrier)
        self.ink = ~space[self.start] & (barrier[self.end] == barrier[self.start])
        word = (self.sums["alnum"][self.end] - self.sums["alnum"][self.start] > 1) & (self.sums["digit"][self.end] == self.sums["digit"][self.start])
        self.marked, self.blocked, self.words = _before(trigger[self.end] - trigger[self.start], (busy[self.end] > busy[self.start]) | (barrier[self.end] > barrier[self.start]), word)
        # what a character is at the edge of a span: a letter or digit, white space, or itself
        self.edge = np.where(alnum, 1, np.where(space, 2, cps.astype(np.int64) + 3))
        own = np.array([_shape(text[a:b]) for a, b in zip(self.start.tolist(), self.end.tolist())], np.uint64)
        self.shapes = prefix(mix(own))
        cue = np.array([_CUE.get(text[a:b].lower(), 0) if b - a <= 12 else 0 for a, b in zip(self.start.tolist(), self.end.tolist())], np.int64)
        self.cue = np.zeros(len(cue), np.int64)  # the last cue word among the five tokens before
        part = barrier[self.start]
        for k in range(1, min(6, len(cue))):
            near = np.zeros(len(cue), np.int64)
            near[k:] = np.where(part[k:] == part[:-k], cue[:-k], 0)
            self.cue = np.where(self.cue == 0, near, self.cue)

    def __len__(self) -> int:
        return len(self.start)

    def candidates(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Token ranges [i, j) of the candidates that begin at the tokens from lo to hi, by i and j."""
        out = []
        for size in range(1, LONGEST + 1):
            i = np.arange(lo, min(hi, len(self) - size + 1))
            j = i + size
            out.append(i[self.ink[i] & self.ink[j - 1] & (self.marked[j] > self.marked[i]) & (self.blocked[j] == self.blocked[i])])
        i = np.concatenate(out)
        j = i + np.repeat(np.arange(1, LONGEST + 1), [len(x) for x in out])
        order = np.lexsort((j, i))
        return i[order], j[order]

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """(candidate, feature) buckets: properties of the whole span, of its edges and of the words before it."""
        a, b = self.start[i], self.end[j - 1]
        digit, alnum, space, mail, point, dash, at, dot = (c[b] - c[a] for c in self.sums.values())
        size = b - a
        bits = lambda x: np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) + (x > 0)
        checked = np.zeros(len(i), np.int64)
        for k in np.flatnonzero((digit >= 12) & (digit <= 19) & (digit + space + dash == size)):
            checked[k] = 1 + luhn("".join(c for c in self.text[a[k] : b[k]] if "0" <= c <= "9"))
        shape = mix(spans(self.shapes, i, j)) >> np.uint64(1)
        values = [
            np.zeros(len(i), np.int64), np.minimum(digit, 20), bits(size), shape.astype(np.int64), mail > 0, np.minimum(point, 4), np.minimum(space, 4),
            ((digit > 0) & (alnum > digit) & (alnum > 15)) * 2 + (alnum == size), self.edge[a] * (1 << 24) + self.edge[b - 1], np.minimum(self.words[j] - self.words[i], 9),
            (at > 0) * 2 + (dot > 0), checked, self.cue[i], self.cue[i] * 32 + bits(np.minimum(digit, 20)), self.edge[a - 1], self.edge[np.minimum(b, len(self.edge) - 1)],
        ]
        names = np.arange(1, len(values) + 1, dtype=np.uint64) << np.uint64(48)
        return (mix(np.stack([v.astype(np.uint64) for v in values], axis=1) + names) % np.uint64(BUCKETS)).astype(np.int64)

    def where(self, i: int, j: int) -> tuple[int, int, int]:
        """(part, start, end) of the tokens [i, j)."""
        a, b = int(self.start[i]), int(self.end[j - 1])
        part = int(np.searchsorted(self.first, a, side="right")) - 1
        return part, a - int(self.first[part]), b - int(self.first[part])


class Field:
    """Weights for every kind (row of BUCKETS) and for a kind following another; kind 0 is a single other token of score 0."""

    def __init__(self) -> None:
        self.w = np.zeros((BUCKETS, len(KINDS)))
        self.follow = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def scored(self, zone: Zone) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, score of every kind) of the candidates that may be in a best segmentation.

        Left out are those that score no better than single other tokens in their
        place, whatever comes before and after.
        """
        f = self.follow
        before, after = (f[:, 1:] - f[:, :1]).max(axis=0), (f[1:] - f[:1]).max(axis=1)
        out = []
        for lo in range(0, len(zone), WINDOW):
            i, j = zone.candidates(lo, lo + WINDOW)
            score = self.w[zone.features(i, j)].sum(axis=1)
            good = (score + before + after > (j - i - 1)[:, None] * f[0, 0]).any(axis=1)
            out.append((i[good], j[good], score[good]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def decode(self, zone: Zone) -> list[tuple[int, int, str]]:
        """(i, j, kind) of the best segmentation.

        Stretches of candidates that touch one another are decided each on its own,
        between other tokens.
        """
        i, j, score = self.scored(zone)
        if not len(i):
            return []
        reach = np.maximum.accumulate(j)
        cut = np.flatnonzero(np.r_[True, i[1:] > reach[:-1], True])
        out: list[tuple[int, int, str]] = []
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
            out += self._stretch(i[x:y].tolist(), j[x:y].tolist(), score[x:y].tolist())
        return out

    def _stretch(self, i: list[int], j: list[int], score: list[list[float]]) -> list[tuple[int, int, str]]:
        """The best segmentation from the first to the last token of the candidates, between other tokens (barriers are such)."""
        follow, kinds = self.follow.tolist(), range(len(KINDS) + 1)
        lo, hi = i[0], max(j)
        best = [[-math.inf] * len(kinds) for _ in range(hi - lo + 1)]
        back: list[list[tuple[int, int]]] = [[(0, 0)] * len(kinds) for _ in range(hi - lo + 1)]
        best[0][0], k = 0.0, 0
        for at in range(lo, hi):
            here = best[at - lo]
            into = [max((here[p] + follow[p][t], -p) for p in kinds) for t in kinds]
            if into[0][0] > best[at + 1 - lo][0]:
                best[at + 1 - lo][0], back[at + 1 - lo][0] = into[0][0], (at, -into[0][1])
            while k < len(i) and i[k] == at:
                there, way = best[j[k] - lo], back[j[k] - lo]
                for t in kinds[1:]:
                    if (got := into[t][0] + score[k][t - 1]) > there[t]:
                        there[t], way[t] = got, (at, -into[t][1])
                k += 1
        at, t = hi, max(kinds, key=lambda t: (best[-1][t] + follow[t][0], -t))
        out = []
        while at > lo:
            was, before = back[at - lo][t]
            if t:
                out.append((was, at, KINDS[t - 1]))
            at, t = was, before
        return out[::-1]

    def learn(self, zone: Zone, given: tuple[np.ndarray, np.ndarray, np.ndarray], gold: list[Span], rate: float) -> None:
        """One gradient step of the log-likelihood of the gold segmentation of a zone of one part; given are its candidates and their features."""
        first, after, feats = given
        cand, score = list(zip(first.tolist(), after.tolist(), strict=True)), self.w[feats].sum(axis=1)
        n, kinds = len(zone), len(KINDS)
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        begin: list[list[int]] = [[] for _ in range(n + 1)]
        for c, (i, j) in enumerate(cand):
            ending[j].append(c)
            begin[i].append(c)
        fwd = np.full((n + 1, kinds + 1), -math.inf)
        fwd[0, 0] = 0
        lse = np.logaddexp.reduce
        into = np.full((n + 1, kinds + 1), -math.inf)  # what may come before a segment of each kind
        into[0] = lse(fwd[0][:, None] + self.follow, axis=0)
        for j in range(1, n + 1):
            fwd[j, 0] = into[j - 1, 0]
            for c in ending[j]:
                fwd[j, 1:] = np.logaddexp(fwd[j, 1:], into[cand[c][0], 1:] + score[c])
            into[j] = lse(fwd[j][:, None] + self.follow, axis=0)
        bwd = np.full((n + 1, kinds + 1), -math.inf)
        bwd[n] = 0
        out = np.full((n + 1, kinds + 1), -math.inf)  # value of starting a segment of each kind here
        for i in range(n - 1, -1, -1):
            out[i, 0] = bwd[i + 1, 0]
            for c in begin[i]:
                out[i, 1:] = np.logaddexp(out[i, 1:], score[c] + bwd[cand[c][1], 1:])
            bwd[i] = lse(self.follow + out[i][None], axis=1)
        z = lse(fwd[n])
        named = {(a, b): k for a, b, k in gold}
        grad_f = np.zeros_like(self.follow)
        for i in range(n):
            grad_f -= np.exp(fwd[i][:, None] + self.follow + out[i][None] - z)
        where, last = 0, 0
        starts = {a: (b, k) for (a, b), k in named.items()}
        ends = {int(b) - 1: j for j, b in enumerate(zone.end)}
        while where < n:
            b, k = starts.get(int(zone.start[where]) - 1, (None, None))
            t = KINDS.index(k) + 1 if k else 0
            grad_f[last, t] += 1
            where, last = (ends[b] + 1 if k else where + 1), t
        for c, (i, j) in enumerate(cand):
            p = -np.exp(into[i, 1:] + score[c] + bwd[j, 1:] - z)
            if k := named.get((int(zone.start[i]) - 1, int(zone.end[j - 1]) - 1)):
                p[KINDS.index(k)] += 1
            np.add.at(self.w, feats[c], rate * p)
        self.follow += rate * 0.1 * grad_f


# ---------------------------------------------------------------- generated sentences


def sentence(rng: random.Random, only: tuple[int, ...] = ()) -> tuple[str, list[Span], int]:
    """A labelled sentence and the number of its template: filler words, an entity or a harmless number, filler words."""
    syllables = "the er on an re ation ing ed en ion que de la le ich sch ung los ra mi ta ver".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    name = lambda: word() + rng.choice(["", "." + word(), digits(2), "." + digits(2)])
    host = lambda: word() + rng.choice([".com", ".org", ".example.com", ".net"])
    q = rng.choice(['"', "'", ""])
    made = [
        (hexes(rng.choice([16, 18, 20, 32, 40])), "secret", rng.choice(["password=", "password: ", "pwd=", "secret="]), ""),
        (hexes(rng.choice([32, 40, 64])), "secret", rng.choice(["token = ", "api_key = ", "token: ", "key="]) + q, q),
        ("AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)), "secret", "", ""),
        (f"{name()} [at] {word()} [dot] com", "email", rng.choice(["", "mail "]), ""),
        (f"{name()}(at){word()}(dot){rng.choice(['com', 'org'])}", "email", "", ""),
        (f"{name()}@{host()}", "email", rng.choice(["", "mail "]), ""),
        (f"({digits(3)}) 555-{digits(4)}", "phone", rng.choice(["", "tel ", "call ", "phone: "]), ""),
        (f"{digits(3)}-555-{digits(4)}", "phone", rng.choice(["", "tel ", "call ", "phone: "]), ""),
        (f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", "phone", "", ""),
        (".".join(str(rng.randint(0, 255)) for _ in range(4)), "ip", rng.choice(["", "host "]), ""),
        (f"{rng.choice('45')}{digits(15)}", "card", rng.choice(["card ", "visa "]), ""),
        (rng.choice([digits(1) + ".0", digits(1) + "." + digits(1), "version " + digits(1), "v" + digits(1) + "." + digits(2)]), "", "", ""),
        (rng.choice(["20" + digits(2), "19" + digits(2), f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}", f"1{digits(1)}:{rng.randint(10, 59)}"]), "", "", ""),
        (rng.choice(["$" + digits(2) + "." + digits(2), digits(3), digits(2) + "%", digits(1) + "," + digits(3), digits(5), "no. " + digits(4), digits(7), digits(9), digits(16)]), "", "", ""),
        (rng.choice([" ", ", ", "\n", " | "]).join(digits(rng.randint(1, 6)) for _ in range(rng.randint(3, 8))), "", "", ""),
        (rng.choice([word() + digits(1), word() + " @ " + word(), "@" + word(), f"{digits(3)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(4)} {word()} {digits(4)}"]), "", "", ""),
    ]
    template = rng.choice(only or range(len(made)))
    entity, kind, lead, tail = made[template]
    before = " ".join(word() for _ in range(rng.randint(0, 5))) + " "
    after = rng.choice([" ", ". ", ", ", "\n"]) + " ".join(word() for _ in range(rng.randint(0, 5)))
    text = before + lead + entity + tail + after
    at = len(before) + len(lead)
    return text, [(at, at + len(entity), kind)] if kind else [], template


@lru_cache(2)
def trained(n: int = 1000, epochs: int = 3, leave: tuple[int, ...] = ()) -> Field:
    """A field learned from n generated sentences, without the templates to be left out."""
    rng, field = random.Random(17), Field()
    data = []
    while len(data) < n:
        text, gold, template = sentence(rng)
        if template not in leave:
            zone = Zone([text])
            i, j = zone.candidates(0, len(zone))
            data.append((zone, (i, j, zone.features(i, j)), gold))
    for e in range(epochs):
        rng.shuffle(data)
        for zone, given, gold in data:
            field.learn(zone, given, gold, 0.2 / (1 + e))
    return field


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches around triggers, wide enough for the longest entity's surroundings, cut between tokens."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    for z in out:  # no token is cut: runs of letters and digits are taken whole
        while z[0] > 0 and _RUN.match(text, z[0]) and _RUN.match(text, z[0] - 1):
            z[0] -= 1
        while z[1] < len(text) and _RUN.match(text, z[1]) and _RUN.match(text, z[1] - 1):
            z[1] += 1
    merged: list[tuple[int, int]] = []
    for a, b in out:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def find_spans(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of every text, each by start and kind."""
    base = [base_spans(t) for t in texts]
    parts, taken, home = [], [], []
    for n, t in enumerate(texts):
        k = 0
        for lo, hi in zones(t):
            while k < len(base[n]) and base[n][k][0] < lo:
                k += 1
            inside, m = [], max(0, k - 1)
            while m > 0 and base[n][m][1] > lo:  # an earlier, longer span may reach into the zone
                m -= 1
            while m < len(base[n]) and base[n][m][0] < hi:
                if base[n][m][1] > lo:
                    inside.append((base[n][m][0] - lo, min(base[n][m][1], hi) - lo))
                m += 1
            parts.append(t[lo:hi])
            taken.append(inside)
            home.append((n, lo))
    more: list[list[Span]] = [[] for _ in texts]
    if parts:
        zone = Zone(parts, taken)
        for i, j, kind in field.decode(zone):
            part, a, b = zone.where(i, j)
            n, lo = home[part]
            more[n].append((lo + a, lo + b, kind))
    return [(x, sorted(x + y, key=lambda s: (s[0], KINDS.index(s[2])))) for x, y in zip(base, more, strict=True)]


def in_groups(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts, null as empty, in groups of about GROUP characters."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


def all_spans(field: Field, texts: list[str | None]) -> Iterator[tuple[list[Span], list[Span]]]:
    for group in in_groups(texts):
        yield from find_spans(field, group)


def pii_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with base and spans, arrays of (kind, start, end)."""
    field = trained()
    kept = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, full = [], []
            for b, s in all_spans(field, batch.column("_text").to_pylist()):
                base.append([{"kind": k, "start": x, "end": y} for x, y, k in b])
                full.append([{"kind": k, "start": x, "end": y} for x, y, k in s])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(base, kind), pa.array(full, kind)], [*kept, "base", "spans"])

    schema = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep))
    span = "array<struct<kind:string,start:int,end:int>>"
    rows = docs.select(*(docs[f"`{c}`"].alias(k) for k, c in zip(kept, keep)), docs[f"`{text}`"].alias("_text"))
    return rows.mapInArrow(run, f"{schema}, base {span}, spans {span}").toDF(*keep, "base", "spans")


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, personal data in the text masked; null texts stay null."""
    field, at = trained(), docs.columns.index(text)
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # columns by position: any name will do

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [t and masked(t, s) for t, (_, s) in zip(texts, all_spans(field, texts), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def _joined(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda found: found == kind


def op1_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter(F.col("base.kind"), _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
