"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns give the base spans (email, ip, card, phone), which stay. The field
looks at the stretches of a text that hold a digit, ``@`` or a cue (a word like password or token,
then ``:`` or ``=``, and a value); everything else
is outside by definition. Over the tokens of a stretch, each candidate segment
of at most ``LONGEST`` tokens has features of the whole span: its form, its
numbers of digits and groups, checks such as Luhn's, what stands before and
after. Its score for a kind is a sum of weights, a token outside scores 0, and
dynamic programming over positions takes the best cut into segments and kinds at
once. The weights are trained by the likelihood of whole segmentations on generated
sentences, so they depend on no table. Segments that meet a base span are not
added.

Spans are code point offsets, end exclusive. A null or empty text has none.
Equal texts have equal spans; rows are never merged or dropped.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tidewheel.llm.common import append

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
BASE_KINDS = KINDS[:4]
#: Tokens of a segment at most; longest stretch of context read before one.
LONGEST, CONTEXT = 14, 24
EXAMPLES, EPOCHS, RATE, DECAY = 980, 8, 0.3, 1e-4

# A token of three dotted parts, or with a short prefix and an underscore, is one token.
TOKEN = re.compile(
    r"[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|[A-Za-z]{2,4}_[A-Za-z0-9]{16,}|[^\W_]+|[^\w\s]|_"
)
_CUE = r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|auth)[\"']?\x20*[:=]\x20*[\"']?[^\s\"']"
CUE = re.compile(_CUE)
EVIDENCE = re.compile(rf"[0-9@]|{_CUE}")
MARKED = re.compile(r"[0-9@]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits is taken from its start, which is where the leftmost match begins.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [2 * int(d) for d in digits[-2::-2]]
    return (sum(odd) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0


def _emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        free = found.end() if found else at + 1
        if found:
            out.append(("email", start, free))
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns: by kind, then by start."""
    out = _emails(text)
    if not DIGITS.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(DIGITS.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Runs without white space that hold a digit, ``@`` or a cue, joined across single spaces."""
    out: list[tuple[int, int]] = []
    done = 0
    for m in EVIDENCE.finditer(text):
        if m.start() < done:
            continue
        start, end = m.start(), m.end()
        # A cue may reach over spaces to its value.
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        done = end
        if out and start - out[-1][1] <= 1:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def segments(text: str, start: int, end: int) -> tuple[list[re.Match], list[tuple[int, int]]]:
    """The tokens of a stretch, and the candidates as first and last token."""
    tokens = list(TOKEN.finditer(text, start, end))
    firsts = [t[0][0].isalnum() or t[0] in "+(" for t in tokens]
    lasts = [t[0][-1].isalnum() for t in tokens]
    values = {m.end() - 1 for m in CUE.finditer(text, start, end)}
    marked = [0]
    for t in tokens:
        marked.append(marked[-1] + (t.start() in values or bool(MARKED.search(t[0]))))
    out = []
    for j in range(len(tokens)):
        if lasts[j]:
            for i in range(max(0, j - LONGEST + 1), j + 1):
                if firsts[i] and marked[j + 1] > marked[i]:
                    out.append((i, j))
    return tokens, out


def features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole span and of what stands beside it."""
    span = text[start:end]
    form = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "d", span))
    form = re.sub(r"(?:ad|da)[ad]*", "x", re.sub(r"\s+", "_", form))
    digits = DIGITS.findall(span)
    groups = [len(g) for g in re.findall(r"\d+", span)]
    n, size = len(digits), end - start
    longest = max((len(t) for t in re.findall(r"[^\W_]+", span)), default=0)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 2]
    cue = re.findall(r"[^\W_]+", before)
    left = before[-1:] or "^"
    right = after[:1] or "^"
    side = [
        "a" if c.isalpha() else "d" if c.isdigit() else "_" if c.isspace() else c for c in (left, right)
    ]
    if side[1] in ".,;:!?)\"'" and (len(after) < 2 or after[1].isspace()):
        side[1] = "_"
    if side[0] in "(\"'":
        side[0] = "_"
    beside = before.rstrip()[-1:]
    marks = "".join(sorted({c for c in span if not c.isalnum()}))[:6]
    out = [
        f"marks={marks}:{n > 0}", f"sizes={'.'.join(map(str, groups[:6]))}", f"after={beside if beside in ':=' else ''}:{cue[-1].lower() if cue else ''}",
        "bias", f"form={form[:24]}", f"digits={min(n, 21)}", f"groups={len(groups)}:{max(groups, default=0)}",
        f"left={side[0]}", f"right={side[1]}", f"around={side[0]}{side[1]}", f"long={min(longest // 6, 6)}",
        f"cue={cue[-1].lower() if cue else ''}", f"first={form[:1]}{min(groups[0], 5) if groups else 0}",
    ]
    if "@" in span:
        host = span.rsplit("@", 1)[1]
        out.append(f"at={span.count('@')}:{'.' in host}:{host[:1].isalnum()}")
    if 13 <= n <= 19 and n + span.count(" ") + span.count("-") == size:
        out += [f"number={n}", f"luhn={luhn(''.join(digits))}", f"even={len(set(groups)) == 1}"]
    if form.count(".") == 3 and len(groups) == 4 and form == "d.d.d.d":
        out.append(f"quad={all(len(g) < 4 and int(g) < 256 for g in span.split('.'))}")
    if not n:
        out.append(f"letters={min(size // 4, 6)}:{span.isalpha()}")
    if n and span[:2].isupper() and IBAN.fullmatch(span):
        digits97 = "".join(str(int(c, 36)) for c in span[4:].replace(" ", "") + span[:4])
        out.append(f"iban={int(digits97) % 97 == 1}")
    if size >= 16 and span.count(".") == 2 and span.startswith("eyJ"):
        out.append("dotted")
    if size >= 20 and "_" in span[2:5] and span.replace("_", "", 1).isalnum():
        out.append("prefixed")
    if size >= 20 and span.isalnum() and 0 < n < size:
        hexa = all(c in "0123456789abcdefABCDEF" for c in span)
        out += [f"mixed={min(size // 8, 5)}", f"hex={hexa}:{size >= 32}"]
    return out


class Field:
    """Weights of features per kind; feature 0 stands for all that are not known."""

    def __init__(self, number: dict[str, int], weights: np.ndarray):
        self.number, self.weights = number, weights

    def find(self, text: str) -> list[Span]:
        out: list[Span] = []
        for start, end in stretches(text):
            out.extend(self._best(text, start, end))
        return out

    def _best(self, text: str, start: int, end: int) -> list[Span]:
        tokens, cands = segments(text, start, end)
        ending = defaultdict(list)
        for i, j in cands:
            ids = [self.number.get(f, 0) for f in features(text, tokens[i].start(), tokens[j].end())]
            scores = self.weights[ids].sum(0)
            k = int(scores.argmax())
            if scores[k] > 0:
                ending[j].append((i, k, float(scores[k])))
        best, back = [0.0], [None]
        for j in range(len(tokens)):
            top, how = best[j], None
            for i, k, s in ending[j]:
                if best[i] + s > top:
                    top, how = best[i] + s, (i, k)
            best.append(top)
            back.append(how)
        out, j = [], len(tokens)
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((KINDS[k], tokens[i].start(), tokens[j - 1].end()))
                j = i
        return out[::-1]


def examples(n: int, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Generated sentences with their spans: half with one of each form, half with look-alikes only."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = "abcdefghijklmnoprstuvwz"
    word = lambda: "".join(pick(*letters) for _ in range(int(rng.integers(2, 9))))
    part = lambda: str(int(rng.integers(0, 256)))
    mixed = lambda k, abc: "".join(pick(*abc) for _ in range(k))

    def secret() -> str:
        size, abc = pick(32, 40, 40, 64), pick("0123456789abcdef", "0123456789abcdef", letters + "0123456789ABCDEFGHJK")
        return mixed(size - 2, abc) + pick("4", "7") + pick("a", "c")

    def token() -> str:
        abc = letters + letters.upper() + "0123456789"
        return pick(
            lambda: "AKIA" + mixed(15, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") + "Q7", lambda: pick("ghp_", "gho_", "sk_", "xox_") + mixed(34, abc) + "a7",
            lambda: ".".join(["eyJ" + mixed(17, abc) + "1x", "eyJ" + mixed(30, abc) + "2z", mixed(40, abc + "-_") + "k3"]),
        )()

    def phrase() -> str:
        return pick(word() + word() + word() + "ab", word() + "-" + word() + num(2), word().title() + num(3) + "!x", word() + "_" + word() + "ty")

    def iban() -> str:
        body, land = num(18), pick("DE", "FR", "GB", "NL", "ES")
        body = body if land == "DE" else "".join(pick(*"ABCDEFGHK") for _ in range(4)) + num(14)
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        whole = f"{land}{check:02d}{body}"
        return pick(whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)))

    pair = lambda: mixed(2, "0123456789abcdef")
    date = lambda: pick(f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/20{num(2)}", f"{num(2)}.{num(2)}.20{num(2)}")
    hour = lambda: pick(f"{num(2)}:{num(2)}", f"{num(2)}:{num(2)}:{num(2)}")
    thousands = lambda: f"{num(pick(1, 2, 3))}" + "".join(pick(",") + num(3) for _ in range(pick(1, 2, 3, 4)))

    def number16() -> str:
        d = num(pick(16, 16, 16, 19))
        return pick(d, d, *([d[:4] + s + d[4:8] + s + d[8:12] + s + d[12:] for s in " -"]))

    good = {
        "email": lambda: pick(word(), word() + "." + num(2), word() + "." + word(), word() + "_" + num(1)) + "@"
        + pick(word(), "mail" + num(1)) + pick("", "." + word()) + pick(".com", ".org", ".net", ".de"),
        "ip": lambda: ".".join(part() for _ in range(4)),
        "card": number16,
        "phone": lambda: pick(
            f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}",
            f"+{num(2)} {num(3)} {num(7)}", f"+{num(2)}-{num(3)}-{num(3)}-{num(3)}", f"+{num(11)}",
        ),
        "secret": lambda: pick(secret, token)(),
        "ssn": lambda: f"{num(3)}-{num(2)}-{num(4)}",
        "iban": iban,
    }
    cues = {"secret": ("token = ", "token: ", "api_key = ", "secret=", "password: ", "key ", "bearer ", word().upper() + "=", ""), "card": ("card ", "", "", ""),
            "phone": ("call ", "phone ", "tel ", "", ""), "email": ("mail ", "to ", "", ""), "ip": ("host ", "from ", "", ""),
            "ssn": ("ssn ", "ssn: ", "social security number ", "", ""), "iban": ("iban ", "iban: ", "to account ", "", "")}
    said = ("password: ", "password = ", "passwd: ", "pwd=", "secret: ", "passphrase: ", "token: ")
    bad = (
        lambda: num(pick(1, 2, 3, 4, 5, 6, 8, 10, 12)), lambda: str(int(rng.integers(1900, 2030))),
        lambda: f"{num(1)}.{num(2)}", lambda: f"${num(2)}.{num(2)}", lambda: f"{num(1)}.{num(1)}.{num(2)}",
        lambda: f"{num(2)}:{num(2)}", lambda: f"20{num(2)}-{num(2)}-{num(2)}", lambda: f"{num(1)},{num(3)},{num(3)}",
        lambda: f"{num(2)}%", lambda: "@" + word(), lambda: word() + num(2), lambda: f"{word().upper()}-{num(4)}",
        lambda: f"{num(3)}.{num(3)}.9{num(2)}.{num(1)}9{num(2)}", lambda: num(pick(21, 24, 30)), lambda: f"{num(2)}/{num(2)}/{num(4)}",
        lambda: f"({num(2)})", lambda: f"{num(3)}-{num(4)}", lambda: f"{num(4)}-{num(4)}", lambda: f"{num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(1)}",
        lambda: f"{word()} @ {num(2)}", lambda: f"{num(4)} {num(4)}", lambda: f"#{num(5)}", lambda: mixed(8, "0123456789abcdef") + "1",
        lambda: f"{num(3)} {num(3)}", lambda: f"{num(10)}-{num(3)}",
        thousands, thousands, lambda: pick("$", "EUR ", "") + thousands() + pick("", f".{num(2)}"),
        lambda: pick(":", "-").join(pair() for _ in range(6)), lambda: ":".join(pair() for _ in range(6)).upper(),
        lambda: ":".join(mixed(pick(1, 4, 4), "0123456789abcdef") for _ in range(8)),
        lambda: "fe80::" + ":".join(mixed(4, "0123456789abcdef") for _ in range(pick(1, 3, 4))), lambda: f"2001:db{num(1)}::{num(pick(1, 2))}",
        lambda: f"{hour()} {date()}", lambda: f"{date()} {hour()}", lambda: f"{date()}T{num(2)}:{num(2)}:{num(2)}Z", lambda: f"{date()} - {date()}",
        date, hour, lambda: f"{hour()}-{hour()}", lambda: f"{num(2)}:{num(2)} to {num(2)}:{num(2)}",
        lambda: ", ".join(num(pick(1, 2, 3)) for _ in range(4)), lambda: " ".join(num(2) for _ in range(pick(3, 5))),
        lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: f"{num(2)}.{num(4)}, -{num(2)}.{num(4)}", lambda: f"{num(1)}x{num(1)}x{num(2)}",
        lambda: f"{num(4)}-{num(4)} {word()}", lambda: f"({num(4)})", lambda: f"{word()}={num(pick(1, 2, 3))}", lambda: f"{num(2)}-{num(2)}",
        lambda: f"token: {pick('a', 'the', 'no')} {word()}", lambda: f"{word()}: {word()}", lambda: f"key = {num(2)}", lambda: f"secret: {pick('it', 'a', 'he')} {word()}",
    )
    out = []
    for i in range(n):
        text, spans = " ".join(word() for _ in range(int(rng.integers(1, 4)))) + " ", []
        for _ in range(2):
            if i % 2 == 0:
                kind = KINDS[(i // 2 + _) % len(KINDS)]
                spoken = kind == "secret" and rng.random() < 0.4
                text += pick(*(said if spoken else cues[kind]))
                quote = pick("", "", '"') if kind == "secret" else ""
                body = phrase() if spoken else good[kind]()
                at = len(text) + len(quote)
                spans.append((kind, at, at + len(body)))
                text += quote + body + quote
            else:
                text += bad[(i // 2 * 2 + _) % len(bad)]()
            text += pick(" ", " ", ". ", ", ", "### ") + word() + " "
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field fitted to the generated sentences by the likelihood of their segmentations."""
    number: dict[str, int] = {}
    prepared = []
    for text, spans in examples(EXAMPLES):
        gold = {(s, t): KINDS.index(k) for k, s, t in spans}
        for start, end in stretches(text):
            tokens, cands = segments(text, start, end)
            ids, right = [], []
            for i, j in cands:
                s, t = tokens[i].start(), tokens[j].end()
                ids.append([number.setdefault(f, len(number) + 1) for f in features(text, s, t)])
                right.append(gold.get((s, t), -1))
            if cands:
                prepared.append((len(tokens), cands, ids, right))
    weights = np.zeros((len(number) + 1, len(KINDS)))
    squares = np.full_like(weights, 1e-2)
    rng = np.random.default_rng(2)
    for _ in range(EPOCHS):
        for at in rng.permutation(len(prepared)):
            n, cands, ids, right = prepared[at]
            scores = np.array([weights[x].sum(0) for x in ids])
            expected = _marginals(n, cands, scores)
            for x, k, p in zip(ids, right, expected):
                grad = -p
                if k >= 0:
                    grad[k] += 1
                grad = grad - DECAY * weights[x].sum(0)
                squares[x] += grad * grad
                weights[x] += RATE * grad / np.sqrt(squares[x])
    weights[0] = 0
    return Field(number, weights)


def _marginals(n: int, cands: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """The probability of each candidate with each kind, by sums forward and backward."""
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0.0
    whole = np.logaddexp.reduce(scores, axis=1)
    ending, starting = defaultdict(list), defaultdict(list)
    for c, (i, j) in enumerate(cands):
        ending[j + 1].append((i, whole[c]))
        starting[i].append((j + 1, whole[c]))
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *[ahead[i] + s for i, s in ending[j]]])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *[behind[j] + s for j, s in starting[i]]])
    first = np.array([ahead[i] for i, _ in cands])
    last = np.array([behind[j + 1] for _, j in cands])
    return np.exp(np.minimum(0, first[:, None] + scores + last[:, None] - ahead[n]))


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans by kind, then start."""
    base = base_spans(text)
    if not base and not EVIDENCE.search(text):
        return base, base
    added = field.find(text)
    if base and added:
        # A base span wins; starts are sorted, so each added one meets its neighbours only.
        taken = sorted((s, t) for _, s, t in base)
        starts = np.array([s for s, _ in taken])
        reach = np.maximum.accumulate([t for _, t in taken])
        kept = []
        for k, s, t in added:
            at = int(np.searchsorted(starts, t, "left"))
            if at == 0 or reach[at - 1] <= s:
                kept.append((k, s, t))
        added = kept
    return base, sorted([*base, *added], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{t}" for k, s, t in spans)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_email``, ``n_ip``, ``n_card`` and ``n_phone`` (base spans), ``base_spans`` and ``spans``."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def make():
        field = sent.value

        def work(texts):
            rows = []
            for x in texts.to_pylist():
                base, every = all_spans(x or "", field)
                kinds = [k for k, _, _ in base]
                rows.append((*map(kinds.count, BASE_KINDS), joined(base), joined(every)))
            return [list(c) for c in zip(*rows)]

        return work

    counts = ", ".join(f"n_{k} bigint" for k in BASE_KINDS)
    return append(docs, make, [text], f"{counts}, base_spans string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; of spans that meet, one stands for all."""
    out, at = [], 0
    for kind, s, t in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, t)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def make():
        field = sent.value
        return lambda texts: [
            [None if x is None else redacted(x, all_spans(x, field)[1]) for x in texts.to_pylist()]
        ]

    names = docs.columns
    return append(docs, make, [text], "_redacted string").withColumnRenamed(text, "_raw").withColumnRenamed("_redacted", text).select(*names)
