"""Personal data: exact patterns, and a semi-Markov conditional random field that adds the spans they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, hash_sample, map_texts, typed

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN, CARD, PHONE, DIGIT = re.compile(r"[0-9]+(?:\.[0-9]+)*"), re.compile(r"[0-9](?:[\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), re.compile(r"[0-9]")
#: What makes a token a trigger. A span holds one at least and up to LONGEST tokens; up to GAP others may stand between two of a region.
SPELT = r"[(\[{<]?(?:at|dot|arroba|chez)[)\]}>]"
MARK, TRIGGER = re.compile("@|" + SPELT, re.I), re.compile("[0-9@]|" + SPELT, re.I)
TOKEN, TRIM = re.compile(r"\S+"), ".,;:!?\"'*#$&|<>~^"
LONGEST, GAP = 11, 1
#: About FIT_DOCS texts are fetched, and of what they hold EXAMPLES examples of up to PIECE tokens are learnt from.
FIT_DOCS, FIT_CHARS, EXAMPLES, PIECE, EPOCHS, RATE = 1500, 20_000, 4000, 64, 4, 0.15


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The exact patterns' matches, each kind from the left without overlap, in order of kind and start. Linear in the text.

    An e-mail's local part reaches as far back from its @ as its characters go, but not into the match before. Of a chain
    of numbers joined by dots each four in turn are one ip match.
    """
    out: list[Span] = []
    at, pos = text.find("@"), 0
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            pos = m.end()
        at = text.find("@", max(at + 1, pos))
    if not DIGIT.search(text):
        return out
    if "." in text:
        for m in CHAIN.finditer(text):
            if m[0].count(".") >= 3:
                parts, start = m[0].split("."), m.start()
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    end = start + len(".".join(four))
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                        out.append(("ip", start, end))
                    start = end + 1
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def regions(text: str, taken: list[Span]) -> Iterator[list[tuple[int, int, bool]]]:
    """Runs of tokens (start, end, trigger) around trigger tokens, without tokens that touch a span already taken.

    An @ or a spelt mark brings the token before it and the LONGEST - 1 after it; digits bring none, as what is made of
    them begins and ends with one."""
    t = TRIGGER.search(text)
    if not t:
        return
    tokens = [m.span() for m in TOKEN.finditer(text)]
    n, i, last = len(tokens), 0, -GAP - 2
    near, trigger = bytearray(n), bytearray(n)
    while t:
        while tokens[i][1] <= t.start():
            i += 1
        a, b = tokens[i]
        begin, end = (max(0, i - 1), min(n, i + LONGEST)) if MARK.search(text, a, b) else (i, i + 1)
        begin = last if i - last <= GAP + 1 else begin
        near[begin:end] = b"\1" * (end - begin)
        trigger[i], last = 1, i
        t = TRIGGER.search(text, b)
    i = 0
    for a, b in sorted((a, b) for _, a, b in taken):
        while i < n and tokens[i][1] <= a:
            i += 1
        while i < n and tokens[i][0] < b:
            near[i] = 0
            i += 1
        i = max(0, i - 1)
    i = near.find(1)
    while i >= 0:
        j = near.find(0, i)
        j = n if j < 0 else j
        if trigger.find(1, i, j) >= 0:
            yield [(*tokens[x], bool(trigger[x])) for x in range(i, j)]
        i = near.find(1, j)


N_FEATURES = 60
#: A whole spelt address; a bracketed mark that ends before, or begins at, a place.
AT, DOT = r"\s*(?:@|[(\[{<]\s*(?:at|arroba|chez)\s*[)\]}>])\s*", r"\s*[(\[{<]\s*(?:dot|punto|point|punkt|\.)\s*[)\]}>]\s*"
ADDRESS = re.compile(rf"[\w.%+-]+(?:{DOT}[\w.%+-]+)*{AT}[\w-]+(?:(?:{DOT}|\.)[\w-]+)+", re.I)
MARK_END, MARK_BEGIN = re.compile(rf"(?:{AT}|{DOT})$", re.I), re.compile(rf"{AT}|{DOT}", re.I)


def features(text: str, a: int, b: int, n: int) -> list[int]:
    """Indices of what holds for the whole candidate text[a:b] of n tokens."""
    s = text[a:b]
    digits = DIGIT.findall(s)
    d, letters = len(digits), sum(c.isalpha() for c in s)
    marks = {c for c in s if not c.isalnum() and not c.isspace()}
    groups = re.findall(r"[0-9]+", s)
    low = s.lower()
    spelt_at, spelt_dot = bool(re.search(r"[(\[{<]\s*(?:at|arroba|chez)\s*[)\]}>]", low)), bool(re.search(r"[(\[{<]\s*(?:dot|punto|point|punkt|\.)\s*[)\]}>]", low))
    f = [0, min(n, 5), 6 + min(d, 20) // 3, 13 + min(len(groups), 6)]
    f += [20] if "@" in s else []
    f += [21] if spelt_at else []
    f += [22] if spelt_dot else []
    f += [23] if ("@" in s or spelt_at) and (spelt_dot or re.search(r"\w\.\w", s)) else []
    f += [24] if s.startswith(("+", "00")) else []
    f += [25] if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and letters <= 9 else []
    f += [26] if 13 <= d <= 19 and luhn("".join(digits)) else []
    f += [27] if 13 <= d <= 19 else []
    f += [28] if 9 <= d <= 15 and not letters else []
    f += [29] if letters == 0 else [30] if letters > d else [31]
    f += [32] if marks and marks <= set("()+-. ") else []
    f += [33] if "(" in marks and ")" in marks and not letters else []
    f += [34] if "=" in marks or ":" in marks or "/" in marks else []
    f += [35] if re.fullmatch(r"(?:\d{4}[ -]?){3,4}\d{0,7}", s) else []
    f += [36] if spelt_dot and len(groups) == 4 and not spelt_at else []
    f += [37] if d == 0 else []
    f += [38] if len(s) < 6 else []
    if "@" in s or spelt_at or spelt_dot:
        f += [39] if ADDRESS.fullmatch(s) else [40]
        f += [41] if MARK_BEGIN.match(s) or MARK_END.search(s[-16:]) else []
        f += [42] if MARK_END.search(text[max(0, a - 16) : a]) or MARK_BEGIN.match(text[b : b + 16]) else []
    f += [43 + min(max(n - 5, 0), 6)] if n > 5 else []
    if d:
        sizes = [len(g) for g in groups]
        f += [52] if letters and d > 6 and not (spelt_at or spelt_dot or "@" in s) else []
        f += [53] if "," in s or ":" in s or "/" in s or "=" in s else []
        f += [54] if len(groups) > 1 and sizes[-1] == 4 and sizes[-2] == 3 and not letters else []
        f += [55] if any(re.fullmatch(r"(?:19|20)\d\d", g) for g in groups) and len(groups) in (3, 4) else []
        f += [56] if sizes.count(1) > 1 else []
        f += [57] if len(groups) > 1 and len(set(sizes)) == 1 and sizes[0] == 4 else []
        f += [58] if d < 7 else []
        f += [59] if s[0] not in "+(0123456789" or not s[-1].isdigit() else []
        f += [50] if text[max(0, a - 2) : a].strip()[-1:].isdigit() and s[0].isdigit() else []
        f += [51] if text[b : b + 2].strip()[:1].isdigit() and s[-1].isdigit() else []
    return f


def trimmed(text: str, run: list[tuple[int, int, bool]], i: int, j: int) -> tuple[int, int]:
    """The ends of tokens i to j without marks of the sentence."""
    a, b = run[i][0], run[j - 1][1]
    while a < b and text[a] in TRIM:
        a += 1
    while b > a and (text[b - 1] in TRIM or text[b - 1] == "%"):
        b -= 1
    return a, b


def candidates(text: str, run: list[tuple[int, int, bool]]) -> Iterator[list[tuple[int, int, int, list[int]]]]:
    """For each end: (begin, a, b, features) of every candidate of up to LONGEST tokens with a trigger."""
    yield []
    last = -1
    for j in range(1, len(run) + 1):
        last, out = j - 1 if run[j - 1][2] else last, []
        for i in range(max(0, j - LONGEST), last + 1):
            a, b = trimmed(text, run, i, j)
            if a < b:
                out.append((i, a, b, features(text, a, b, j - i)))
        yield out


@dataclass
class Example:
    """A run's candidates in order of their ends; gold: (place, kind) of the true ones, which take `inside` tokens."""

    tokens: int
    begin: np.ndarray
    end: np.ndarray
    features: np.ndarray
    gold: list[tuple[int, int]]
    inside: int


def example(text: str, run: list[tuple[int, int, bool]], gold: list[Span]) -> Example:
    all_of = [(i, j, a, b, f) for j, found in enumerate(candidates(text, run)) for i, a, b, f in found]
    want = {(a, b): KINDS.index(c) for c, a, b in gold}
    x = np.zeros((len(all_of), N_FEATURES), dtype=bool)
    for row, (*_, f) in zip(x, all_of, strict=True):
        row[f] = True
    true = [(at, want.pop((a, b))) for at, (_, _, a, b, _) in enumerate(all_of) if (a, b) in want]
    places = np.array([c[:2] for c in all_of], dtype=np.int64).reshape(-1, 2)
    return Example(len(run), places[:, 0], places[:, 1], x, true, sum(len(TOKEN.findall(text[a:b])) for _, a, b in gold))


@dataclass
class Model:
    """Weights of (kind, feature), of a change of kinds (0: begin), and of a token outside of spans."""

    w: np.ndarray
    change: np.ndarray
    outside: float = 0.0

    def best(self, text: str, run: list[tuple[int, int, bool]]) -> list[Span]:
        """The jointly best segmentation by dynamic programming over ends and the kind of the last span. Candidates are
        made end by end, so a run may have any length."""
        k, n = len(KINDS), len(run)
        score = np.full((n + 1, k + 1), -np.inf)
        score[0, 0] = 0
        begin, before = np.full((n + 1, k + 1), -1, dtype=np.int32), np.zeros((n + 1, k + 1), dtype=np.int8)
        for j, found in enumerate(candidates(text, run)):
            if j:
                score[j] = score[j - 1] + self.outside
            for i, _, _, f in found:
                s, by = self.w[:, f].sum(axis=1), score[i][:, None] + self.change
                came = by.argmax(axis=0)
                for c in range(k):
                    v = by[came[c], c] + s[c]
                    if v > score[j, c + 1]:
                        score[j, c + 1], begin[j, c + 1], before[j, c + 1] = v, i, came[c]
        j, c, out = n, int(score[-1].argmax()), []
        while j:
            i = int(begin[j, c])
            if i < 0:
                j -= 1
            else:
                out.append((KINDS[c - 1], *trimmed(text, run, i, j)))
                j, c = i, int(before[j, c])
        return out[::-1]

    def learn(self, example: Example, rate: float) -> None:
        """A step up the log-likelihood of the gold segmentation: forward and backward sums over all segmentations."""
        k, n, begin, end, x = len(KINDS), example.tokens, example.begin, example.end, example.features.astype(np.float64)
        s = x @ self.w.T
        fw, bw = np.full((n + 1, k + 1), -np.inf), np.zeros((n + 1, k + 1))
        fw[0, 0] = 0
        lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
        cuts = np.searchsorted(end, np.arange(n + 2))
        for j in range(1, n + 1):
            fw[j] = fw[j - 1] + self.outside
            if cuts[j] < cuts[j + 1]:
                own = slice(cuts[j], cuts[j + 1])
                fw[j, 1:] = np.logaddexp(fw[j, 1:], lse(lse(fw[begin[own]][:, :, None] + self.change, 1) + s[own], 0))
        order = np.argsort(begin, kind="stable")
        cuts = np.searchsorted(begin[order], np.arange(n + 1))
        for i in range(n - 1, -1, -1):
            bw[i] = bw[i + 1] + self.outside
            if cuts[i] < cuts[i + 1]:
                own = order[cuts[i] : cuts[i + 1]]
                bw[i] = np.logaddexp(bw[i], lse(lse(self.change + (s[own] + bw[end[own], 1:])[:, None, :], 2), 0))
        z = lse(fw[n], 0)
        p = np.exp(fw[begin][:, :, None] + self.change + (s + bw[end, 1:])[:, None, :] - z)
        gw, gc, prev = -p.sum(axis=1).T @ x, -p.sum(axis=0), 0
        for at, c in example.gold:
            gw[c] += x[at]
            gc[prev, c] += 1
            prev = c + 1
        # Tokens outside: expected and, with the rest, the gold's.
        found = n - example.inside - np.exp(lse(fw[:-1] + self.outside + bw[1:], 1) - z).sum()
        self.w += rate * gw - rate * 1e-3 * self.w
        self.change += rate * gc - rate * 1e-3 * self.change
        self.outside += 0.1 * rate * found


def altered(text: str, span: Span, rng: np.random.Generator) -> str:
    """The found item in a form that the patterns miss, of up to LONGEST tokens."""
    kind, s = span[0], text[span[1] : span[2]]
    o, c = [("(", ")"), ("[", "]")][int(rng.integers(2))]
    if kind == "email":
        gap = " " if rng.random() < 0.7 else ""
        s = s.replace("@", f"{gap}{o}at{c}{gap}")
        if rng.random() < 0.5:
            gap = gap if 2 * s.count(".") + 3 <= LONGEST else ""
            s = s.replace(".", f"{gap}{o}dot{c}{gap}")
        return s
    if kind == "ip":
        return s.replace(".", f"{o}.{c}" if rng.random() < 0.5 else f"{o}dot{c}")
    digits = re.sub(r"\D", "", s)
    if kind == "phone":
        form = rng.random()
        if form < 0.25 and len(digits) >= 10:
            area, rest, mark = digits[-10:-7], digits[-7:], ["-", ".", " "][int(rng.integers(3))]
            return (f"({area}) " if rng.random() < 0.3 else area + mark) + rest[:3] + (mark if mark != " " or rng.random() < 0.5 else "-") + rest[3:]
        if form < 0.5:
            digits += "".join(map(str, rng.integers(0, 10, max(0, int(rng.integers(9, 14)) - len(digits)))))  # numbers of any length
            n = int(rng.integers(1, 4))
            code, rest, m = digits[:n], digits[n:], int(rng.integers(2, 4))
            groups = [rest[:m], *(rest[i : i + 2] for i in range(m, len(rest), 2))]
            return " ".join([["00", code], ["00" + code], [code]][int(rng.integers(3))] + groups)
        return s.lstrip("+") if rng.random() < 0.5 else "00" + s.lstrip("+")
    return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))


def numbers(rng: np.random.Generator) -> str:
    """A few numbers of everyday text that are no personal data, with words between: dates, times, prices, versions, places
    in books, book numbers, keys."""
    n = lambda a, b: int(rng.integers(a, b))
    forms = (
        lambda: f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", lambda: f"{n(1, 29)}/{n(1, 13)}/{n(1900, 2100)}", lambda: f"{n(0, 24):02}:{n(0, 60):02}", lambda: f"{n(1, 999)},{n(0, 1000):03}.{n(0, 100):02}",
        lambda: f"{n(0, 20)}.{n(0, 20)}.{n(0, 20)}", lambda: f"{n(1, 99)}", lambda: f"{n(1, 9999)}", lambda: f"97{n(8, 10)}-{n(0, 10)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 10)}", lambda: f"{n(1, 400)}-{n(400, 999)}",
        lambda: f"{n(1, 99)}.{n(0, 99)}%", lambda: f"{n(1, 1 << 31):08x}{n(1, 1 << 31):08x}", lambda: f"{n(1900, 2100)}-{n(1900, 2100)}", lambda: f"{n(1, 13):02}.{n(1, 29):02}.{n(1900, 2100)}",
    )
    word = lambda: "".join(chr(97 + n(0, 26)) for _ in range(n(1, 8)))
    return " ".join(x for _ in range(n(1, 6)) for x in ([word()] if rng.random() < 0.5 else []) + [forms[n(0, len(forms))]() + ("," if rng.random() < 0.2 else "")])


def by_hash(items: list, key, most: int) -> list:
    """Up to `most` of the items, those of the least hashes."""
    return sorted(items, key=lambda x: (hashlib.blake2b(key(x).encode("utf-8", "replace"), digest_size=8).digest(), key(x)))[:most]


def fit(texts: list[str], seed: int = 3, examples: int = EXAMPLES) -> Model:
    """Trained on regions of the texts: what the patterns find is gold, also rewritten into forms that they miss; every
    other number, mark or word around is outside. So the field learns spans by their whole form, and what is no such span.

    Of all the texts' regions (in pieces of PIECE tokens) a quarter of `examples` is taken, and of all their items a
    quarter, each in three forms; both by a hash of the text and place. An eighth more are everyday numbers made by rule."""
    rng = np.random.default_rng(seed)
    golds = [base_spans(text) for text in texts]
    pieces = [(n, run[i][0], run[min(i + PIECE, len(run)) - 1][1]) for n, gold in enumerate(golds) for run in regions(texts[n], gold) for i in range(0, len(run), PIECE)]
    data = [(texts[n][a:b], []) for n, a, b in by_hash(pieces, lambda x: f"{x[1]} {texts[x[0]]}", examples // 4)]
    for n, span in by_hash([(n, span) for n, gold in enumerate(golds) for span in gold], lambda x: f"{x[1][1]} {texts[x[0]]}", examples // 4):
        text = texts[n]
        begin, end = max([span[1] - 40, 0, *(b for _, _, b in golds[n] if b <= span[1])]), min([span[2] + 80, *(a for _, a, _ in golds[n] if a >= span[2])])
        left, right = text[begin : span[1]].split()[-3:], text[span[2] : end].split()[: LONGEST - 1]
        for plain in (True, False, False):
            item = text[span[1] : span[2]] if plain else altered(text, span, rng)
            head = " ".join([*left, ""])
            data.append((head + item + " " + " ".join(right), [(span[0], len(head), len(head) + len(item))]))
    data += [(numbers(rng), []) for _ in range(min(examples // 8, len(data)))]
    model = Model(np.zeros((len(KINDS), N_FEATURES)), np.zeros((len(KINDS) + 1, len(KINDS))))
    learnt = [example(text, run, [g for g in gold if run[0][0] <= g[1] and g[2] <= run[-1][1]]) for text, gold in data for run in regions(text, [])]
    for epoch in range(EPOCHS if any(g for _, g in data) else 0):
        for i in rng.permutation(len(learnt)):
            model.learn(learnt[i], RATE / (1 + epoch))
    if not any(g for _, g in data):
        model.w[:, 0] = -10
    return model


def train(documents: DataFrame, docs: int = FIT_DOCS, max_chars: int = FIT_CHARS) -> Model:
    """Fit on about `docs` texts of up to max_chars characters that hold a trigger, chosen by a hash of the text."""
    own = documents.select("text").where(F.length("text").between(1, max_chars) & F.col("text").rlike("(?i)" + TRIGGER.pattern))
    return fit(sorted({r["text"] for r in hash_sample(own, "text", docs).distinct().collect()}))


def find_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans; both by kind as listed, then by start. Added spans touch no base span."""
    base = base_spans(text)
    added = [s for run in regions(text, base) for s in model.best(text, run)]
    added = [s for s in added if not any(s[1] < b and a < s[2] for _, a, b in base)]
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row; null text counts as empty.

    Rows are handled one by one, so ids may be null or repeated; extra columns are not read. Without any pattern match to
    learn from, the field adds nothing.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            found = [find_spans(t.decode("utf-8", "replace"), shared.value) for t in texts]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(told(base).encode()).hexdigest() for base, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([told(s) for _, s in found])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    own = documents.select("doc_id", "text")
    return map_texts(own, run, typed(own.select("doc_id"), "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"))


def redacted(text: str, spans: list[Span]) -> str:
    """Each span becomes its kind in angle brackets; overlapping ones become one, of the first's kind."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, model: Model) -> DataFrame:
    """documents with the spans of every text masked; all rows and columns stay, null texts too."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, find_spans(t, shared.value)[1]) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.names[place], pa.array(texts, pa.string()))

    return map_texts(documents, run, documents.schema)
