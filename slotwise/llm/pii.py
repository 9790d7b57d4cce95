"""Personal data: fixed base patterns, and a semi-Markov conditional random
field that finds what the patterns miss.

The base spans are fixed segments. Between them, windows around digits, signs
like @ and spelled-out signs are cut into tokens, and the field scores whole
candidate segments of each type (email, ip, card, phone) by features of the
whole span: its form, digits, groups, separators, checksum, what it would cut
off at either end, and the words before it. Dynamic programming over the
window, with segments of bounded length, chooses boundaries and types together;
a chosen segment is reported if its marginal probability is high. The weights
maximise the conditional likelihood of windows from a bounded sample of
documents, whose base spans are shown in disguised forms, and of generated
windows; the probability that is asked for is set on examples kept out of the
training.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as SqlWindow
from pyspark.sql import functions as F

from slotwise.llm.common import documents
from slotwise.llm.spans import Span, digest, joined, masked

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: Fixed patterns, those of the base kinds rewritten to run in linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
GROUPED = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

SAMPLE_DOCS = 4000  # expected number of documents that the field learns from, at most
SAMPLE_WINDOWS = 300  # windows of a kind, and windows without base spans, at most
GENERATED = 2000  # generated spans, each beside a window without one
EPOCHS, RATE, DECAY = 8, 0.4, 1e-3
LONGEST = (24, 19, 19, 16)  # tokens of a segment, at most
REACH = max(LONGEST)  # tokens beside an anchor that belong to its window
FALSE = 0.001  # share of kept-out windows without personal data in which the field may report a span
CONTEXT = 24  # characters of context that are kept of a span seen in a document


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, the failing ones dropped."""
    found: list[Span] = []
    end = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((EMAIL, start, m.end()))
            end = m.end()
    if not DIGIT.search(text):
        return found
    for m in DOTTED.finditer(text) if "." in text else ():
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):  # four at a time, from the left
            four = parts[i : i + 4]
            stop = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((IP, at, stop))
            at = stop + 1
    for m in GROUPED.finditer(text):
        if 12 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((CARD, m.start(), m.end()))
    for m in PLUS.finditer(text) if "+" in text else ():
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append((PHONE, m.start(), m.end()))
    return found


# ---- windows and candidate segments

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)
SIGN = re.compile(r"[0-9@]|[(\[{]\s?(?:at|AT|At)\s?[)\]}]|(?<!\w)(?:at|AT|At)(?!\w)")
AT = frozenset(("@", "at", "AT", "At"))
DOT = frozenset(("dot", "DOT", "Dot"))
OPEN, CLOSE = frozenset("([{<"), frozenset(")]}>")
CUES = (
    frozenset(("email", "mail", "write", "contact", "reach", "address")),
    frozenset(("ip", "address", "host", "server", "node", "gateway", "ping")),
    frozenset(("card", "visa", "mastercard", "credit", "account", "amex", "pan")),
    frozenset(("phone", "tel", "call", "fax", "mobile", "cell", "number", "telephone", "ring", "text", "dial")),
)
DIGITS = frozenset("0123456789")
ARTICLES = frozenset(("the", "a", "an", "this", "that", "these", "my", "your", "his", "her", "its", "our", "their", "one", "any", "all", "each", "least", "last", "first", "home", "work"))
#: A name or a domain that goes on before or after a segment.
BEFORE = re.compile(r"[^\W_](?:[._%+-]|\s?[\[({]\s?(?:dot|DOT|Dot|\.)\s?[\])}]\s?|\s(?:dot|DOT|Dot|\.)\s)$")
AFTER = re.compile(r"(?:[.-]|\s?[\[({]\s?(?:dot|DOT|Dot|\.)\s?[\])}]\s?|\s(?:dot|DOT|Dot|\.)\s)[^\W_]")


def _is_number(x: str) -> bool:
    return x[0] in DIGITS


class Window:
    """Tokens of a stretch of text; ``start`` holds each token's place."""

    def __init__(self, text: str, a: int, b: int):
        self.tokens = [(m[0], m.start() + a) for m in TOKEN.finditer(text[a:b])]
        self.start = [p for _, p in self.tokens] + [b]
        self.before = {w.lower() for w in re.findall(r"[^\W\d_]+", text[max(0, a - 24) : a])}

    def segments(self) -> Iterator[tuple[int, int, int, list[str]]]:
        """(first token, end token, kind, features) of each candidate."""
        t = [x for x, _ in self.tokens]
        for i, first in enumerate(t):
            if _is_number(first) or first in "+(" and i + 2 < len(t) and (_is_number(t[i + 1]) or t[i + 1] == "(" or t[i + 1] == " " and first == "+"):
                yield from self._numbers(t, i)
            elif first in AT:
                yield from self._emails(t, i)

    def _numbers(self, t: list[str], i: int) -> Iterator[tuple[int, int, int, list[str]]]:
        digits, groups, form, marks, words = "", 0, "", set(), False
        for j in range(i, min(len(t), i + max(LONGEST[1:]))):
            x = t[j]
            if _is_number(x):
                digits += x
                groups += 1
                form += str(min(len(x), 10))
                if len(digits) > 19:
                    return
            else:
                if x == "\n" or x[0].isalpha() and x not in DOT:
                    return
                words |= x in DOT
                marks.add("dot" if x in DOT else " " if x.isspace() else x)
                form += "dot" if x in DOT else " " if x.isspace() else x
                continue
            n = j + 1 - i
            if groups == 4 and len(digits) <= 12 and first_is_number(t, i) and n <= LONGEST[IP] and ("dot" in form or "." in form):
                yield i, j + 1, IP, self._number_features(IP, t, i, j + 1, digits, groups, form, marks)
            if not words:
                if 12 <= len(digits) and first_is_number(t, i) and n <= LONGEST[CARD]:
                    yield i, j + 1, CARD, self._number_features(CARD, t, i, j + 1, digits, groups, form, marks)
                if 7 <= len(digits) <= 15 and n <= LONGEST[PHONE]:
                    yield i, j + 1, PHONE, self._number_features(PHONE, t, i, j + 1, digits, groups, form, marks)

    def _near(self, t: list[str], i: int) -> set[str]:
        return {x.lower() for x in t[max(0, i - 8) : i]} | (self.before if i < 8 else set())

    def _number_features(self, k: int, t: list[str], i: int, j: int, digits: str, groups: int, form: str, marks: set[str]) -> list[str]:
        seen, near = t[i:j], self._near(t, i)
        between = {m for m in re.split(r"[0-9]+", form)[1:-1]}
        out = ["bias", f"form={form}" if len(form) < 24 else "long form", f"marks={''.join(sorted(marks))}", f"n={len(digits)}", f"groups={min(groups, 7)}", f"between={min(len(between), 4)}"]
        out += ["cue"] * bool(near & CUES[k]) + ["other cue"] * any(near & c for n, c in enumerate(CUES) if n != k)
        left, right = t[i - 1] if i else " ", t[j] if j < len(t) else " "
        more_left = i > 1 and _is_number(t[i - 2]) and not left.isspace()
        more_right = j + 1 < len(t) and _is_number(t[j + 1]) and not right.isspace()
        out += ["left word"] * (left[0].isalnum() or left in "_=/@") + ["right word"] * (right[0].isalnum() or right in "_=/@%")
        out += ["left number"] * more_left + ["right number"] * more_right
        out += ["left money"] * (left in "$€£¥" or i > 1 and left.isspace() and t[i - 2] in "$€£¥")
        out += ["left spaced number"] * (i > 1 and left.isspace() and _is_number(t[i - 2])) + ["right spaced number"] * (j + 1 < len(t) and right.isspace() and _is_number(t[j + 1]))
        if k == IP:
            good = all(len(x) <= 3 and int(x) <= 255 and (x == "0" or x[0] != "0") for x in seen if _is_number(x))
            out += ["octets" if good else "no octets"]
            one = next(iter(between)) if len(between) == 1 else "mixed"
            out += [f"one form={one}", f"octets={good} whole={not (more_left or more_right)} mixed={one == 'mixed'}"]
        elif k == CARD:
            checked, mark = "luhn" if luhn(digits) else "no luhn", "one mark" if len(between) == 1 else "mixed" if between else "plain"
            out += [checked, mark, f"{checked} {mark}"]
        else:
            lengths = [len(x) for x in seen if _is_number(x)]
            out += [f"plus={seen[0] == '+'}", f"lengths={'-'.join(map(str, lengths[:6]))}", f"last={min(lengths[-1], 6)}", f"least={min(min(lengths), 4)}", "bracket" if "(" in marks else "no bracket"]
            out += ["open"] * (form.count("(") != form.count(")")) + ["date"] * bool(re.fullmatch(r"(?:19|20)[0-9]{2}[-/. ](?:0?[1-9]|1[0-2])[-/. ][0-3]?[0-9]|[0-3]?[0-9][-/. ][0-3]?[0-9][-/. ](?:19|20)[0-9]{2}|(?:1[5-9]|20)[0-9]{2} ?- ?(?:1[5-9]|20)[0-9]{2}", "".join(seen)))
        return [f"{KINDS[k]} {x}" for x in out]

    def _emails(self, t: list[str], at: int) -> Iterator[tuple[int, int, int, list[str]]]:
        """Candidates around the sign at token ``at``: a name, the sign, a domain."""
        low, high = at, at + 1  # the sign with the blanks and brackets around it
        while low > 0 and (t[low - 1] in " \t" or t[low - 1] in OPEN) and at - low < 3:
            low -= 1
        while high < len(t) and (t[high] in " \t" or t[high] in CLOSE) and high - at < 4:
            high += 1
        around = "".join(t[low:high])
        sign = ("@" if t[at] == "@" else "at") + ("bracket" if OPEN & set(around) else "") + ("spaced" if " " in around or "\t" in around else "")
        if t[at] != "@" and sign == "at":
            return  # inside a word
        ends = []
        spelled, dots, gaps = False, 0, 0
        for j in range(high, min(len(t), at + LONGEST[EMAIL])):
            x = t[j]
            if x == "\n" or x in AT:
                break
            if x in DOT or x == ".":
                dots, spelled = dots + 1, spelled or x in DOT
            elif x.isspace() and not _by_dot(t, j):
                gaps += 1
                if gaps > 2:
                    break
            elif x[0].isalnum() and dots:
                ends.append((j + 1, dots, spelled, gaps))
        if not ends:
            return
        gaps, joined_dots = 0, False
        for i in range(low - 1, max(-1, low - LONGEST[EMAIL] // 2 - 1), -1):
            x = t[i]
            if x == "\n" or x in AT:
                break
            if x.isspace() and not _by_dot(t, i):
                gaps += 1
                if gaps > 2:
                    break
            joined_dots |= x in DOT
            if x[0].isalnum() and x not in DOT:
                for j, dots, spelled, domain_gaps in ends:
                    if j - i <= LONGEST[EMAIL]:
                        yield i, j, EMAIL, self._email_features(t, i, j, low, high, sign, dots, spelled, gaps, domain_gaps)

    def _email_features(self, t: list[str], i: int, j: int, low: int, high: int, sign: str, dots: int, spelled: bool, gaps: int, domain_gaps: int) -> list[str]:
        near, last = self._near(t, i), t[j - 1]
        name, domain = t[i:low], t[high:j]
        odd = sum(not (x[0].isalnum() or x in "._%+-" or x.isspace() or x in DOT or x in OPEN or x in CLOSE) for x in [*name, *domain])
        left, right = t[i - 1] if i else " ", t[j] if j < len(t) else " "
        cut_left = left[0].isalnum() or bool(BEFORE.search("".join(t[max(0, i - 6) : i])))
        after = "".join(t[j : j + 4])
        cut_right = right[0].isalnum() or bool(AFTER.match(after)) and not re.match(r"\.\s", after)
        tld = last.isalpha() and last.isascii() and 2 <= len(last) <= 6
        out = ["bias", f"sign={sign}", f"sign={sign} spelled={spelled}", f"dots={min(dots, 4)}", f"name gaps={gaps}", f"domain gaps={domain_gaps}", f"odd={min(odd, 2)}", "ending" if tld else "no ending"]
        out += ["cue"] * bool(near & CUES[EMAIL]) + ["cut left"] * bool(cut_left) + ["cut right"] * bool(cut_right)
        if tld and domain[0].lower() not in ARTICLES and not (cut_left or cut_right or gaps or domain_gaps or odd):
            out.append(f"whole {sign} {spelled}")
        article = bool(domain) and domain[0].lower() in ARTICLES
        out += ["article"] * article
        out += ["empty label"] * (domain[0] in "._-" if domain else True) + ["number domain"] * all(not x[0].isalpha() for x in domain)
        return [f"email {x}" for x in out]


def first_is_number(t: list[str], i: int) -> bool:
    return _is_number(t[i])


def _by_dot(t: list[str], j: int) -> bool:
    """Whether a blank belongs to a dot that is set off or spelled out."""
    beside = t[j - 1 : j] + t[j + 1 : j + 2]
    return any(x in DOT for x in beside) or t[j + 1 : j + 2] == ["."] or any(x in OPEN for x in t[j + 1 : j + 2]) or t[j - 1] in CLOSE


def windows(text: str, fixed: list[Span]) -> Iterator[Window]:
    """Windows around anchors, apart from the fixed segments: up to ``REACH``
    tokens on either side, whole tokens always. A bare "at" is an anchor where
    a spelled-out dot follows."""
    walls = sorted((a, b) for _, a, b in fixed)
    spelled = "dot" in text or "DOT" in text or "Dot" in text
    w, open_a, open_b, n = 0, -1, -1, len(text)
    last = -1
    for m in SIGN.finditer(text):
        at = m.start()
        if at < last:  # covered by the anchor before, whose window reaches as far in tokens
            continue
        if m[0][0].isalpha() and not (spelled and re.search(r"(?i)\bdot\b", text[m.end() : m.end() + 200])):
            continue
        while w < len(walls) and walls[w][1] <= at:
            w += 1
        if w < len(walls) and walls[w][0] < m.end():
            continue
        floor = walls[w - 1][1] if w else 0
        ceiling = walls[w][0] if w < len(walls) else n
        low, high = _tokens_back(text, at, floor), _tokens_on(text, m.end(), ceiling)
        if open_b >= low and open_a >= floor:
            open_b = max(open_b, high)
        else:
            if open_b > open_a:
                yield Window(text, open_a, open_b)
            open_a, open_b = low, high
        last = m.end()
    if open_b > open_a:
        yield Window(text, open_a, open_b)


def _tokens_on(text: str, at: int, ceiling: int) -> int:
    """The place ``REACH`` tokens after one, at most."""
    for k, m in enumerate(TOKEN.finditer(text, at, ceiling)):
        if m[0] == "\n" or k >= REACH:
            return m.start()
        at = m.end()
    return at


def _tokens_back(text: str, at: int, floor: int) -> int:
    """The place about ``REACH`` tokens before one, at the start of a token:
    the tokens of 256 characters are looked at, or of more where one token
    fills them."""
    size = 256
    while True:
        low = max(floor, at - size)
        while low > floor and text[low].isalnum() and text[low - 1].isalnum():
            low -= 1
        line = text.rfind("\n", low, at)
        starts = [m.start() for m in TOKEN.finditer(text, max(low, line + 1), at)]
        if starts or low == floor or line >= low or at == low:
            return starts[-REACH] if len(starts) >= REACH else starts[0] if starts else at
        size *= 4


# ---- the field


def _log_add(x: float, y: float) -> float:
    if x == -math.inf:
        return y
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def lattice(window: Window, weights: dict[str, float]) -> list[tuple[int, int, int, list[str], float]]:
    return [(i, j, k, f, sum(weights.get(x, 0.0) for x in f)) for i, j, k, f in window.segments()]


def marginals(n: int, segments: list[tuple]) -> list[float]:
    """Probability of each segment; a token outside segments scores zero."""
    into, out_of = defaultdict(list), defaultdict(list)
    for s in segments:
        into[s[1]].append(s)
        out_of[s[0]].append(s)
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for e in range(1, n + 1):
        ahead[e] = ahead[e - 1]
        for s in into[e]:
            ahead[e] = _log_add(ahead[e], ahead[s[0]] + s[4])
    for e in range(n - 1, -1, -1):
        behind[e] = behind[e + 1]
        for s in out_of[e]:
            behind[e] = _log_add(behind[e], behind[s[1]] + s[4])
    return [math.exp(min(0.0, ahead[s[0]] + s[4] + behind[s[1]] - ahead[n])) for s in segments]


def decoded(n: int, segments: list[tuple]) -> list[int]:
    """Numbers of the segments on the best path."""
    into = defaultdict(list)
    for x, s in enumerate(segments):
        into[s[1]].append(x)
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    for e in range(1, n + 1):
        best[e] = best[e - 1]
        for x in into[e]:
            if best[segments[x][0]] + segments[x][4] > best[e]:
                best[e], back[e] = best[segments[x][0]] + segments[x][4], x
    out, e = [], n
    while e:
        if back[e] >= 0:
            out.append(back[e])
            e = segments[back[e]][0]
        else:
            e -= 1
    return out[::-1]


def train(examples: list[tuple[str, list[Span]]]) -> dict[str, float]:
    """Weights of the features, by gradient ascent on the conditional
    likelihood of the examples (text, true spans)."""
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1.0)
    ready = []
    for text, spans in examples:
        w = Window(text, 0, len(text))
        segments = list(w.segments())
        if segments:
            gold = {(k, a, b) for k, a, b in spans}
            ready.append((len(w.tokens), segments, [(k, w.start[i], w.start[j]) in gold for i, j, k, _ in segments]))
    order = random.Random(5)
    for _ in range(EPOCHS):
        order.shuffle(ready)
        for n, segments, gold in ready:
            scored = [(i, j, k, f, sum(weights[x] for x in f)) for i, j, k, f in segments]
            step: dict[str, float] = defaultdict(float)
            for s, g, p in zip(scored, gold, marginals(n, scored), strict=True):
                if abs(g - p) > 1e-4:
                    for x in s[3]:
                        step[x] += g - p
            for x, d in step.items():
                d -= DECAY * weights[x]
                squares[x] += d * d
                weights[x] += RATE * d / math.sqrt(squares[x])
    return dict(weights)


# ---- examples


def _disguised(kind: int, x: str, r: random.Random) -> str:
    """A form of personal data that the base patterns miss."""
    if kind == EMAIL:
        local, _, domain = x.partition("@")
        dot = r.choice([".", " dot ", " dot ", "[dot]", "(dot)", " [dot] ", " (dot) ", " . "])
        sign = r.choice([" @ ", "(at)", "[at]", " [at] ", " (at) ", "{at}", " at ", " at ", " AT ", "@ ", " @"])
        if sign.strip() in ("at", "AT"):  # with plain dots it is a place, not an address
            dot = r.choice([" dot ", " DOT ", "[dot]", " (dot) "])
        elif "@" in sign and dot == ".":
            sign = r.choice([" @ ", "@ ", " @"])
        spelled = local.replace(".", dot) if "dot" in dot and r.random() < 0.5 else local
        return spelled + sign + domain.replace(".", dot)
    if kind == IP:
        return x.replace(".", r.choice([" . ", "[.]", "(.)", "[dot]", "(dot)", " dot ", "{.}", ". ", " [.] "]))
    digits = re.sub(r"[^0-9]", "", x)
    if kind == CARD:
        sizes = r.choice([(4, 4, 4, 4, 4), (4, 4, 4, 4, 4), (4, 6, 5, 4)])
        at = [sum(sizes[:i]) for i in range(len(sizes))]
        return r.choice([".", "  ", "/", "_", " - ", ". "]).join(digits[a : a + n] for a, n in zip(at, sizes, strict=True) if a < len(digits))
    d = digits[-10:].rjust(10, "5")
    land, sep = r.choice(["44", "49", "33", "1", "351"]), r.choice([" ", "-", ".", " "])
    return r.choice(
        [
            f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"({d[:3]}){d[3:6]}-{d[6:]}", f"({d[:3]}) {d[3:6]} {d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}", f"1-{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}/{d[3:6]}-{d[6:]}",
            f"0{d[:2]}{sep}{d[2:6]}{sep}{d[6:]}", f"0{d[0]}{sep}{d[1:3]}{sep}{d[3:5]}{sep}{d[5:7]}{sep}{d[7:9]}", f"00{land}{sep}{d[:3]}{sep}{d[3:6]}{sep}{d[6:]}", f"+{land}/{d[:3]}/{d[3:]}", f"+ {land} {d[:3]} {d[3:6]} {d[6:]}", f"0{d[:3]}/{d[3:]}", f"({d[:2]}) {d[2:6]}-{d[6:]}",
        ]
    )


def _made(kind: int, r: random.Random) -> str:
    some = lambda n, of="0123456789": "".join(r.choice(of) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    if kind == EMAIL:
        name = r.choice(["", "", "J", "M"]) + some(r.randint(2, 12), letters) + r.choice(["", "", "." + some(r.randint(2, 11), letters), some(2), "_" + some(4, letters), "-" + some(3, letters), "." + some(2)])
        return f"{name}@{some(r.randint(2, 12), letters)}{r.choice(['', '', some(1), '-' + some(4, letters), '.' + some(5, letters)])}.{r.choice(['com', 'org', 'net', 'de', 'io', 'edu', 'info', 'example.com', 'co.uk'])}"
    if kind == IP:
        return ".".join(str(r.choice([r.randint(0, 255), 10, 192, 168, 172])) for _ in range(4))
    if kind == CARD:
        body = r.choice(["4", "5", "37", "6011", ""])
        body += some(r.choice([15, 15, 15, 14, 13]) - len(body))
        return next(body + d for d in "0123456789" if luhn(body + d))
    return f"+{r.randint(1, 9)} ({some(3)}) {some(3)}-{some(4)}"


def _plain(r: random.Random) -> str:
    """Numbers, signs and words that are no personal data."""
    n = lambda a, b: str(r.randint(a, b))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    sep = r.choice([" ", " ", "-", ".", ", ", "/", "  "])
    card = _made(CARD, r)
    wrong = card[:-1] + str((int(card[-1]) + r.randint(1, 9)) % 10)  # no checksum
    return r.choice(
        [
            f"{n(1, 30)}.{n(0, 9)}.{n(0, 20)}", f"{n(1990, 2030)}-{n(1, 12).zfill(2)}-{n(1, 28).zfill(2)}", f"{n(1, 28).zfill(2)}.{n(1, 12).zfill(2)}.{n(1990, 2030)}", f"{n(10, 23)}:{n(10, 59)}:{n(10, 59)}", n(1, 10**9), f"{n(256, 999)}.{n(256, 999)}.{n(256, 999)}.{n(256, 999)}",
            f"{n(1, 9)},{n(100, 999)},{n(100, 999)}.{n(10, 99)}", f"{n(1, 99)} @ {n(1, 99)}", n(10**6, 10**16), n(10**15, 10**16 - 1), f"{n(1990, 2020)} {n(1990, 2020)}", f"{n(1900, 2020)}-{n(1900, 2020)}", f"{n(10000, 99999)}-{n(1000, 9999)}",
            f"{n(10**6, 10**9)}-{n(10, 99)}", f"{n(1, 12)}/{n(1, 28)}/{n(1990, 2030)} {n(1, 9999999)}", f"a{n(10**8, 10**12)}f{n(10**5, 10**7)}", f"={n(10**9, 10**12)}", f"978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}", f"{n(100, 999)}-{n(10**6, 10**7 - 1)}-{n(10**6, 10**7 - 1)}",
            r.choice([".", "  ", "/", "_", " - "]).join(wrong[i : i + 4] for i in range(0, 16, 4)), sep.join(n(1, 999) for _ in range(r.randint(3, 9))), sep.join(n(1000, 99999) for _ in range(r.randint(2, 6))), f"{n(1, 99)}.{n(10**4, 10**7)}, {n(1, 180)}.{n(10**4, 10**7)}", f"${n(1, 999)}.{n(100, 999)}.{n(100, 999)}",
            f"{n(1, 20)} . {n(1, 20)}", f"[{n(1, 99)}] [{n(1, 99)}] [{n(1, 99)}] [{n(1, 99)}]", f"({n(1, 99)}) ({n(1, 99)}) ({n(1900, 2020)})", f"section {n(1, 9)}.{n(1, 9)}.{n(1, 9)}.{n(1, 9)}.{n(1, 9)}", f"{n(1, 999)} x {n(1, 999)} x {n(1, 999)} x {n(1, 999)}", f"{n(1, 9)} dot {n(1, 99)}",
            f"{word()} at {word()}.{word()}", f"{word()} at {word()} {word()}", f"{word()} at the dot", f"{word()} at {word()}. The dot {word()}", f"look at {word()}.com", f"@{word()} {word()}. {word()}", f"{word()} @ {word()}", f"{word()} @{word()} {word()} . {word()}", f"{word()} (at) {word()}", f"{word()} at {n(1, 12)}.{n(10, 59)} {word()}", f"a dot {word()} at {word()}, then {word()}",
        ]
    )


CONTEXTS = (
    ("of the ", "to reach ", "und die ", "la que ", "tel ", "contact ", "call me at ", "phone ", "", "email: ", "ip ", "my card ", "number: ", "server ", "write to ", "ring ", "visa ", "host=", "(", "The ", "is, ", "text: ", "y los "),
    (" and on", " der", ", in", ".", "", " or so", "\n", ") then", "; la", " please", "!", " 2 of 3", ". The dot"),
)


def examples(seen: list[tuple[int, str, str, str]], seed: int = 3, generated: int | None = None) -> list[tuple[str, list[Span]]]:
    """Windows from spans seen in documents (kind, left context, span, right
    context; kind -1: a window without base spans) and generated ones, the
    spans disguised; every other window has none."""
    r = random.Random(seed)
    rows = [*seen, *((r.randrange(4), "", "", "") for _ in range(GENERATED if generated is None else generated))]
    out: list[tuple[str, list[Span]]] = []
    for kind, left, span, right in rows:
        if kind < 0:
            out.append((span, []))
            continue
        left, right = left or r.choice(CONTEXTS[0]), right or r.choice(CONTEXTS[1])
        span = _disguised(kind, span or _made(kind, r), r)
        out.append((left + span + right, [(kind, len(left), len(left) + len(span))]))
        out.append((left + _plain(r) + right, []))
    return out


class Finder:
    """The field, and the probability that it asks for by kind."""

    def __init__(self, weights: dict[str, float], certain: tuple[float, ...] = (0.5,) * len(KINDS)):
        self.weights, self.certain = weights, certain

    def scored(self, text: str, base: list[Span]) -> Iterator[tuple[float, Span]]:
        """Segments on the best paths, with their probabilities."""
        for w in windows(text, base):
            segments = lattice(w, self.weights)
            if any(s[4] > 0 for s in segments):
                p = marginals(len(w.tokens), segments)
                for x in decoded(len(w.tokens), segments):
                    i, j, k = segments[x][:3]
                    yield p[x], (k, w.start[i], w.start[j])

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Segments beside the base spans that the field is certain of."""
        return [s for p, s in self.scored(text, base) if p >= self.certain[s[0]]]

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        base = base_spans(text)
        return base, base + self.added(text, base)


def learned(seen: list[tuple[int, str, str, str]]) -> Finder:
    """The field, trained on four of five seen windows and on generated ones;
    the probability to ask for is the least of each kind, from 0.5 to 0.99, at
    which hardly any of the kept-out windows without personal data gets a span."""
    kept_out = [x for n, x in enumerate(seen) if n % 5 == 0]
    finder = Finder(train(examples([x for n, x in enumerate(seen) if n % 5])))
    clean = [text for text, gold in examples(kept_out, seed=4, generated=GENERATED) if not gold]
    wrong: list[list[float]] = [[] for _ in KINDS]
    for text in clean:
        for p, (k, _, _) in finder.scored(text, base_spans(text)):
            wrong[k].append(p)
    allowed = int(FALSE * len(clean))
    finder.certain = tuple(min(0.99, max([0.5, *sorted(w, reverse=True)[allowed : allowed + 1]]) + 1e-9) for w in wrong)
    return finder


def fit(docs: DataFrame) -> Finder:
    """The field, learned from a bounded sample of documents dealt by hash: of
    each kind the base spans, and windows without any, with the smallest
    hashes, so that the sample doesn't depend on how the documents lie."""
    rows = documents(docs)
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**30)) < int(share * 2**30))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple]] = {k: [] for k in (*range(len(KINDS)), -1)}
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py()
                base = base_spans(text)
                found = [(k, text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT]) for k, a, b in base]
                # one window of a text, so that a page of figures isn't the sample
                found += [(-1, "", text[w.start[0] : w.start[-1]], "") for w in islice(windows(text, base), 1)]
                for row in found:
                    kept[row[0]].append((hashlib.md5("\0".join(map(str, row)).encode("utf-8", "surrogatepass")).digest(), *row))
            kept = {k: heapq.nsmallest(SAMPLE_WINDOWS, x) for k, x in kept.items()}
        rows = [x for of_kind in kept.values() for x in of_kind]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.binary(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], ["hash", "kind", "left", "span", "right"])

    rank = F.row_number().over(SqlWindow.partitionBy("kind").orderBy("hash"))  # of bounded size
    found = chosen.mapInArrow(seen, "hash binary, kind int, left string, span string, right string").dropDuplicates(["hash"]).withColumn("rank", rank).where(F.col("rank") <= SAMPLE_WINDOWS).orderBy("hash").select("kind", "left", "span", "right")
    return learned([tuple(r) for r in found.collect()])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per
    document. The counts and the digest are of the base spans, ``spans`` holds
    the field's too.

    A null or empty text has no spans, and very long ones are read whole;
    repeated rows give repeated results and a null doc_id is kept; further
    columns, whatever their names, play no part. An empty table gives no rows.
    """
    finder = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[] for _ in KINDS], [], []
            for text in batch.column("text"):
                base, every = finder.value.spans(text.as_py())
                for k, c in enumerate(counts):
                    c.append(sum(s[0] == k for s in base))
                digests.append(digest(base, KINDS))
                spans.append(joined(every, KINDS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return documents(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked and ``n_chars`` (if there
    is one) counted anew; other columns stay, null texts stay null, and
    repeated rows, very long texts and empty tables are as in ``find``."""
    finder = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x if x is None else masked(x, finder.value.spans(x)[1], KINDS) for x in batch.column("text").to_pylist()]
            new = {"text": pa.array(texts, batch.column("text").type)}
            if "n_chars" in names:
                new["n_chars"] = pa.array([None if x is None else len(x) for x in texts], batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names)

    return docs.mapInArrow(run, docs.schema)
