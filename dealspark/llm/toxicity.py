"""Toxicity: a support vector machine over a gapped-subsequence string kernel with Nystroem landmarks.

A text is a bag of sentences, a sentence a run of words, each begun by a mark that stands for the space before it. The
kernel compares windows of a sentence (one to WORDS neighbouring words, marks included) with landmarks by their common
subsequences of three characters, so letters put in, left out or parted by a space cost little.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, held_out, labelled_sample, map_texts, typed

#: A subsequence of three characters spans at most SPAN places and is decayed by DECAY for each of them.
DECAY, SPAN, ALPHABET = 0.7, 9, 64
#: Letters of a window at most (longer words are cut into overlapping parts), words of a window, marks that open a word.
UNIT, WORDS, MARK = 16, 3, 0
LANDMARKS, FLOOR, RIDGE, ROUNDS, BIAS = 160, 3e-2, 1e-4, 5, -1.0
#: Texts of each class (clean, toxic) that are fitted on, and their longest; words scored at once.
PER_CLASS, MAX_CHARS, PREDICT_AT, PIECE = (2000, 800), 20_000, 0.5, 30_000
#: Margins under this say nothing and count as it, as does a missing (second, third) window.
NO_UNIT = -0.7
#: What the sentence of the greatest margin, taken as a text of its own, weighs beside its whole text.
ALONE = 0.12
POINTS = 0x30000


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its kind (0 other, 1 white space, 2 letter or digit) and its lower-cased letter's code."""
    kind, code = np.zeros(POINTS + 1, dtype=np.uint8), np.zeros(POINTS + 1, dtype=np.uint8)
    for i in range(POINTS):
        c = chr(i)
        if c.isalnum():
            low = ord(c.lower()[0])
            kind[i], code[i] = 2, low - 96 if 97 <= low < 123 else 27 + low % 37
        elif c.isspace():
            kind[i] = 1
    return kind, code


@dataclass
class Words:
    """All words of some texts in one stream of codes: each from its mark to behind its last letter."""

    stream: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    sentence: np.ndarray
    text: np.ndarray

    def part(self, i: int, j: int) -> Words:
        """Words i to j, with those after them that share a window."""
        k = min(j + WORDS - 1, len(self.begin))
        a, b = (self.begin[i], self.end[k - 1]) if k > i else (0, 0)
        return Words(self.stream[a:b], self.begin[i:k] - a, self.end[i:k] - a, self.sentence[i:k], self.text[i:k])


def read(texts: list[str]) -> Words:
    """Words end at white space; other characters than letters and digits vanish, so marks between letters hide nothing.
    Sentences end at a full stop, an exclamation or question mark before white space, and at line ends. Three or more
    single characters in a row are one word."""
    kind, code = tables()
    a = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    a = np.minimum(a, POINTS)
    k = kind[a]
    space, letter = k == 1, np.flatnonzero(k == 2)
    after = np.append(space[1:], True)
    stop = (a == 10) | (((a == 33) | (a == 46) | (a == 63)) & after) | (a == 0x3002)
    places = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if not len(letter):
        return Words(np.zeros(0, dtype=np.uint8), *(np.zeros(0, dtype=np.int32) for _ in range(4)))
    word = np.cumsum(space, dtype=np.int32)[letter]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    length = np.diff(np.append(first, len(letter)))
    at = letter[first]
    text = np.searchsorted(places, at, side="right") - 1
    single = length == 1
    joins = single & np.append(False, single[:-1]) & (text == np.append(-1, text[:-1]))
    run = np.cumsum(~joins)
    joins &= np.bincount(run)[run] >= 3
    first, at, text = first[~joins], at[~joins], text[~joins]
    length = np.diff(np.append(first, len(letter)))
    begin = first + np.arange(len(first))
    stream = np.zeros(len(letter) + len(first), dtype=np.uint8)
    own = np.ones(len(stream), dtype=bool)
    own[begin] = False
    stream[own] = code[a[letter]]
    narrow = lambda x: x.astype(np.int32)
    return Words(stream, narrow(begin), narrow(begin + 1 + length), np.cumsum(stop, dtype=np.int32)[at], narrow(text))


@dataclass
class Windows:
    """Windows of a stream: places [begin, end), first word, and how many words (0: a part of a long one)."""

    begin: np.ndarray
    end: np.ndarray
    word: np.ndarray
    words: np.ndarray


def windows(w: Words, upto: int | None = None) -> Windows:
    """All windows of three letters or more that begin at the first `upto` words."""
    n = len(w.begin) if upto is None else min(upto, len(w.begin))
    i, out = np.arange(n), []
    letters = w.end - w.begin - 1
    for m in range(1, WORDS + 1):
        j = i[: max(0, min(n, len(w.begin) - m + 1))]
        size = w.end[j + m - 1] - w.begin[j] - m
        j = j[(size >= 3) & (size <= UNIT) & (w.sentence[j] == w.sentence[j + m - 1]) & (w.text[j] == w.text[j + m - 1])].astype(np.int32)
        out.append((w.begin[j], w.end[j + m - 1], j, np.full(len(j), m, dtype=np.int8)))
    long = np.flatnonzero(letters[:n] > UNIT)
    if len(long):
        parts = -(-(letters[long] - UNIT) // (UNIT // 2)) + 1
        word = np.repeat(long, parts)
        step = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = w.begin[word] + (UNIT // 2) * step + (step > 0)
        out.append((begin.astype(np.int32), np.minimum(begin + UNIT + (step == 0), w.end[word]).astype(np.int32), word.astype(np.int32), np.zeros(len(word), dtype=np.int8)))
    return Windows(*(np.concatenate(x) for x in zip(*out, strict=True)))


def norms(length: np.ndarray) -> np.ndarray:
    """The root of the self-kernel of so many characters that all differ: what a window's sum is divided by."""
    n, total = np.asarray(length, dtype=np.float64), np.zeros(len(length))
    for span in range(3, SPAN + 1):
        total += np.maximum(n - span + 1, 0) * (span - 2) * DECAY ** (2 * span)
    return np.sqrt(np.maximum(total, 1e-12))


def sums(stream: np.ndarray, begin: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each window the normalised sum of its subsequences, each by its weight [ALPHABET^3]. What begins at a place
    with a given span is summed once for all windows; running sums then give any window's."""
    c, out = stream.astype(np.int64), np.zeros(len(begin))
    pairs = [(c[:-j] * ALPHABET + c[j:]) * ALPHABET for j in range(1, min(SPAN - 1, len(c)))]
    for span in range(3, min(SPAN, len(c)) + 1):
        m = len(c) - span + 1
        d = np.zeros(m, dtype=np.float32)
        for j in range(1, span - 1):
            d += weights[pairs[j - 1][:m] + c[span - 1 :]]
        run = np.concatenate([[0.0], np.cumsum(d, dtype=np.float64)])
        out += DECAY**span * (run[np.minimum(np.maximum(end - span + 1, begin), m)] - run[np.minimum(begin, m)])
    return out / norms(end - begin)


def subsequences(unit: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a unit's subsequences and their normalised weights."""
    c = np.frombuffer(unit, dtype=np.uint8).astype(np.int64)
    t = triples(len(c))
    ids = (c[t[:, 0]] * ALPHABET + c[t[:, 1]]) * ALPHABET + c[t[:, 2]]
    own, place = np.unique(ids, return_inverse=True)
    return own, np.bincount(place, DECAY ** (t[:, 2] - t[:, 0] + 1.0), minlength=len(own)) / norms(np.array([len(c)]))


@functools.cache
def triples(n: int) -> np.ndarray:
    return np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]).reshape(-1, 3)


class Kernel:
    """The kernel between units met so far and landmarks, each value computed once; landmarks are kept as the few
    subsequences that they have, so memory stays with units times landmarks."""

    def __init__(self) -> None:
        self.marks: list[bytes] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.at: dict[bytes, int] = {}
        self.values = np.zeros((0, 0), dtype=np.float32)

    def block(self, units: list[bytes], parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(units), len(parts)), dtype=np.float32)
        lengths, flat = np.array([len(u) for u in units]), np.zeros(ALPHABET**3, dtype=np.float32)
        for n in np.unique(lengths):
            at, t = np.flatnonzero(lengths == n), triples(int(n))
            decay = (DECAY ** (t[:, 2] - t[:, 0] + 1.0) / norms(np.array([n]))).astype(np.float32)
            for start in range(0, len(at), 2048):
                own = at[start : start + 2048]
                c = np.frombuffer(b"".join(units[i] for i in own), dtype=np.uint8).reshape(-1, n).astype(np.int64)
                ids = (c[:, t[:, 0]] * ALPHABET + c[:, t[:, 1]]) * ALPHABET + c[:, t[:, 2]]
                for j, (part, weight) in enumerate(parts):
                    flat[part] = weight
                    out[own, j] = flat[ids] @ decay
                    flat[part] = 0
        return out

    def rows(self, units: list[bytes]) -> np.ndarray:
        new = [u for u in dict.fromkeys(units) if u not in self.at]
        if new:
            known = len(self.at)
            self.at.update((u, known + i) for i, u in enumerate(new))
            self.values = np.concatenate([self.values, self.block(new, self.parts)])
        return self.values[[self.at[u] for u in units]]

    def add(self, marks: list[bytes]) -> None:
        parts = [subsequences(u) for u in marks]
        self.values = np.concatenate([self.values, self.block(list(self.at), parts)], axis=1)
        self.marks += marks
        self.parts += parts

    def half_inverse(self) -> np.ndarray:
        """The inverse root of the kernel among the landmarks, without its least directions."""
        gram = self.rows(self.marks).astype(np.float64)
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        ok = value > FLOOR
        return vector[:, ok] / np.sqrt(value[ok])

    def folded(self, beta: np.ndarray) -> np.ndarray:
        """One weight per subsequence: the landmarks' sum by beta."""
        out = np.zeros(ALPHABET**3)
        for b, (own, weight) in zip(beta, self.parts, strict=True):
            out[own] += b * weight
        return out.astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray  # the machine's weight of each subsequence: sum of beta * landmark
    bias: float
    steps: np.ndarray = field(default_factory=lambda: np.array([4.0, 1.0, 1.0, 0.0]))  # of the three margins, and a constant

    def best(self, texts: list[str]) -> np.ndarray:
        """The three greatest margins of each text, each of another unit."""
        w, out = read(texts), np.full((len(texts), 3), NO_UNIT)
        for i in range(0, len(w.begin), PIECE):
            margin, text, _ = self.margins(w.part(i, i + PIECE), min(PIECE, len(w.begin) - i))
            if len(text):
                self.top(margin, text, out)
        return out

    def hardest(self, w: Words, texts: np.ndarray, least: float = -0.5, most: int = 2000) -> dict[bytes, float]:
        """Units of these texts (marked by True) with the greatest margins over `least`, and in how many texts."""
        found: dict[bytes, list] = {}
        for i in range(0, len(w.begin), PIECE):
            part = w.part(i, i + PIECE)
            margin, text, win = self.margins(part, min(PIECE, len(w.begin) - i))
            for j in np.flatnonzero(texts[text] & (margin > least)) if len(text) else ():
                own = found.setdefault(part.stream[win.begin[j] : win.end[j]].tobytes(), [-float(margin[j]), set()])
                own[1].add(int(text[j]))
        first = sorted(found, key=lambda u: (found[u][0], u))[:most]
        return {u: float(len(found[u][1])) for u in first}

    def margins(self, w: Words, upto: int | None = None) -> tuple[np.ndarray, np.ndarray, Windows]:
        """(margin, text, window) of what counts in each sentence: every word, and the best window of several words if none
        of these is toxic by itself."""
        win = windows(w, upto)
        margin = sums(w.stream, win.begin, win.end, self.weights) + self.bias
        several = win.words > 1
        alone = np.full(len(w.begin) + WORDS, -np.inf)
        np.maximum.at(alone, win.word[~several], margin[~several])
        which = np.flatnonzero(several & (margin > 0))
        clear = np.maximum.reduce([np.where(m < win.words[which], alone[win.word[which] + m], -np.inf) for m in range(WORDS)]) <= 0
        which = which[clear]
        order = which[np.lexsort((-margin[which], w.sentence[win.word[which]]))]
        which = order[np.diff(w.sentence[win.word[order]], prepend=-1) != 0] if len(order) else order
        keep = np.sort(np.concatenate([np.flatnonzero(~several), which]))
        keep = keep[np.argsort(win.word[keep], kind="stable")]
        return margin[keep], w.text[win.word[keep]], Windows(win.begin[keep], win.end[keep], win.word[keep], win.words[keep])

    @staticmethod
    def top(margin: np.ndarray, text: np.ndarray, out: np.ndarray) -> None:
        """Merge into out; text ascends. Equal margins are of equal units and count once."""
        first = np.flatnonzero(np.diff(text, prepend=-1))
        own, group = text[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(text))))
        m, found = margin.copy(), [out[own]]
        for _ in range(3):
            best = np.maximum.reduceat(m, first)
            found.append(np.maximum(best, NO_UNIT)[:, None])
            m[m >= best[group]] = -np.inf
        out[own] = -np.sort(-np.concatenate(found, axis=1), axis=1)[:, :3]

    def score(self, best: np.ndarray) -> np.ndarray:
        z = np.minimum(best, 2.0) @ self.steps[:3] + self.steps[3]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def variants(unit: bytes, rng: np.random.Generator, n: int = 4) -> list[bytes]:
    """The unit with a letter or space put in, doubled, changed or left out, so that the machine learns to bear this."""
    out = []
    for _ in range(n if 5 <= len(unit) <= UNIT else 0):
        i, x = int(rng.integers(2, len(unit))), bytes([int(rng.integers(1, 27))])
        out += [unit[:i] + x + unit[i:], unit[:i] + unit[i - 1 : i] + unit[i:], unit[:i] + bytes([MARK]) + unit[i:]]
        if len(unit) > 6:
            out += [unit[: i - 1] + unit[i:], unit[: i - 1] + bytes([27 + int(rng.integers(37))]) + unit[i:]]
    return out


def _hashes(w: Words, win: Windows, least: int = 5, most: int = 9) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, hash, window): of the first `least` to `most` places of single words, and (size 0) of all other windows."""
    h, length = np.zeros(len(win.begin), dtype=np.uint64), win.end - win.begin
    for i in range(int(length.max()) if len(length) else 0):
        on = np.flatnonzero(length > i)
        h[on] = (h[on] + w.stream[win.begin[on] + i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h[on] ^= h[on] >> np.uint64(29)
        if least <= i + 1 <= most:
            on = on[win.words[on] == 1]
            yield i + 1, h[on], on
    on = np.flatnonzero((win.words != 1) | (length < least) | (length > most))
    yield 0, h[on], on


def _counts(h: np.ndarray, text: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, clean texts, toxic texts), by ascending hash."""
    order = np.lexsort((text, h))
    h, text = h[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.zeros(0, bool)
    h, c = h[new], y[text[new]]
    own, place = np.unique(h, return_inverse=True)
    return own, np.bincount(place, 1 - c, len(own)), np.bincount(place, c, len(own))


def _evidence(clean: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Minus the logarithm of a bound on the chance to be in toxic texts so often, if it were no sign of them."""
    n = np.maximum(clean + toxic, 1)
    q = np.clip(toxic / n, 1e-12, 1 - 1e-12)
    return np.where(q > share, n * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share))), 0.0)


def signs(w: Words, win: Windows, y: np.ndarray, part: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Units that set toxic texts apart, strongest first, and for each window whether it is or begins with one.

    A unit must be too frequent in toxic texts for chance among so many units, on the texts of part 0, and then again by
    itself on the held-back part 1. Those whose counts a longer unit around them explains are left out."""
    text, found = w.text[win.word], {0: [], 1: []}
    for _, h, at in _hashes(w, win):
        for p, of in found.items():
            on = part[text[at]] == p
            own, clean, toxic = _counts(h[on], text[at[on]], y)
            ok = toxic > (2 if p == 0 else 0)  # rarer units can't pass, so they are no trials
            of.append((own[ok], clean[ok], toxic[ok]))
    (own, clean, toxic), (back, clean_back, toxic_back) = ([np.concatenate(x) for x in zip(*found[p], strict=True)] for p in (0, 1))
    share = [max(y[part == p].sum(), 1) / max(1, (part == p).sum()) for p in (0, 1)]
    strength, again = _evidence(clean, toxic, share[0]), dict(zip(back.tolist(), _evidence(clean_back, toxic_back, share[1]).tolist(), strict=True))
    ok = [i for i in np.flatnonzero(strength > np.log(max(2, len(own))) + 3) if again.get(int(own[i]), 0) > 3]
    ok = sorted(ok, key=lambda i: own[i])
    sure = own[ok]
    inside, units = np.zeros(len(win.begin), dtype=bool), {}
    for size, h, at in _hashes(w, win) if len(sure) else ():
        number = np.minimum(np.searchsorted(sure, h), len(sure) - 1)
        hit = np.flatnonzero(sure[number] == h)
        inside[at[hit]] = True
        for k, i in zip(*np.unique(number[hit], return_index=True), strict=True):  # one of each, to read its letters from
            b, e = win.begin[at[hit[i]]], win.end[at[hit[i]]]
            units[w.stream[b : b + size if size else e].tobytes()] = (float(strength[ok[k]]), float(toxic[ok[k]]))
    kept = [u for u in units if not any(v != u and u in v and units[v][1] >= 0.8 * units[u][1] for v in units)]
    names = sorted(kept, key=lambda u: (-units[u][0], u))
    starts = {u[:4] for u in names}
    for i in np.flatnonzero(inside & (win.words == 1)):  # not by a beginning that was left out
        own_bytes = w.stream[win.begin[i] : win.end[i]].tobytes()
        inside[i] = own_bytes[:4] in starts and any(own_bytes.startswith(u) for u in names)
    return names, inside


def _unlike(w: Words, n: int, least: int = 4) -> np.ndarray:
    """Which texts share fewer than `least` of their 8 least word hashes with every earlier one: copies would make a rare
    unit look frequent."""
    whole = Windows(w.begin, np.minimum(w.end, w.begin + UNIT), np.arange(len(w.begin)), np.zeros(len(w.begin), dtype=np.int8))
    *_, (_, h, _) = _hashes(w, whole)
    keep, seen = np.ones(n, dtype=bool), {}
    bounds = np.searchsorted(w.text, np.arange(n + 1))
    for i in range(n):
        low = np.unique(h[bounds[i] : bounds[i + 1]])[:8].tolist()
        before = [seen[x] for x in low if x in seen]
        if len(low) >= 8 and before and max(map(before.count, before)) >= least:
            keep[i] = False
        else:
            for x in low:
                seen.setdefault(x, i)
    return keep


def fit(rows: list[tuple[str, int]], landmarks: int = LANDMARKS, seed: int = 5) -> Model | None:
    """rows: (text, toxic). Sentences take their text's label: those of clean texts are clean; a toxic text has a toxic
    sentence, told by windows that hold a sign (see `signs`); a toxic text without any teaches nothing.

    Landmarks are the signs, some clean units, and the clean windows of the greatest margins met on the way. The kernel
    with them gives Nystroem features, on which a linear machine is trained by squared hinge loss. Its weights fold into
    one weight per subsequence. A third of the texts is held back: there each sign must show again, and there the score is
    fitted to the three greatest margins of each text, and to the greatest alone, as of a text of one sentence.
    """
    rng = np.random.default_rng(seed)
    all_texts, all_y = [t for t, _ in rows], np.array([c for _, c in rows], dtype=np.int64)
    kept = np.flatnonzero(_unlike(read(all_texts), len(rows))) if rows else np.zeros(0, int)
    texts, y = [all_texts[i] for i in kept], all_y[kept]
    if len(set(y.tolist())) < 2:
        return None
    part = np.zeros(len(y), dtype=np.int64)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        part[rng.permutation(own)[: len(own) // 3]] = 1
    w = read(texts)
    win = windows(w)
    names, inside = signs(w, win, y, part)
    if not names:
        return None
    text = w.text[win.word]
    learnt = part[text] == 0
    name = lambda at: [w.stream[win.begin[i] : win.end[i]].tobytes() for i in at]
    # A toxic text weighs 1, shared by its signs, so that a sign that comes alone weighs more than one of many.
    witness = np.flatnonzero(inside & learnt & (y[text] == 1))
    own = np.bincount(text[witness], minlength=len(y))
    weight: dict[bytes, float] = {}
    for u, t in zip(name(witness), text[witness], strict=True):
        weight[u] = weight.get(u, 0) + 1 / own[t]
    total = sum(weight.values())
    clean = np.flatnonzero(learnt & (y[text] == 0))
    starts = {u[:4] for u in names}
    close = [u for u in name(clean[win.words[clean] == 1]) if u[:4] in starts]
    some = list(dict.fromkeys([*name(rng.permutation(clean)[:8000]), *(close[i] for i in rng.permutation(len(close))[:3000])]))
    negative: dict[bytes, float] = dict.fromkeys(some, total / len(some))
    varied = {v for u in names[:60] for v in variants(u, rng)} - {*negative, *weight}
    weight |= dict.fromkeys(sorted(varied), 0.5 * total / max(1, len(varied)))
    kernel, some_varied = Kernel(), sorted(varied)
    kernel.add([*names[:landmarks], *(some_varied[i] for i in rng.permutation(len(varied))[: landmarks // 2]), *(some[i] for i in rng.permutation(len(some))[: landmarks // 4] if some[i] not in names[:landmarks])])
    half_inverse = kernel.half_inverse()
    for step in range(ROUNDS):
        z = kernel.rows([*negative, *weight]) @ half_inverse
        s = np.repeat([-1.0, 1.0], [len(negative), len(weight)])
        cost = np.array([*negative.values(), *weight.values()])
        model = Model(kernel.folded(half_inverse @ _squared_hinge(z, s, cost / cost.sum())), BIAS)
        if step == ROUNDS - 1:
            break
        found = model.hardest(w, (y == 0) & (part == 0))
        for u, n in found.items():
            negative[u] = max(n, negative.get(u, 0))
        kernel.add([u for u in found if u not in kernel.marks and u not in names][: landmarks // 2])
        half_inverse = kernel.half_inverse()
    best, kind = np.minimum(model.best([texts[i] for i in np.flatnonzero(part)]), 2.0), y[part == 1]
    alone = np.where([True, False, False], best, NO_UNIT)  # as if the sentence of the greatest margin were the text
    model.steps = _calibrate(np.concatenate([best, alone]), np.concatenate([kind, kind]), np.repeat([1.0, ALONE], len(kind)))
    return model


def _squared_hinge(z: np.ndarray, s: np.ndarray, cost: np.ndarray, ridge: float = RIDGE, steps: int = 60) -> np.ndarray:
    """Newton steps on the support vectors of the moment. The bias is fixed, so that what is like no landmark is clean."""
    w = np.zeros(z.shape[1])
    loss = lambda v: ridge * v @ v + (cost * np.maximum(0, 1 - s * (z @ v + BIAS)) ** 2).sum()
    for _ in range(steps):
        active = s * (z @ w + BIAS) < 1
        xa, ca = z[active], cost[active]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + ridge * np.eye(z.shape[1]), (xa * ca[:, None]).T @ (s[active] - BIAS))
        if np.abs(new - w).max() < 1e-6:
            break
        part = next((a for a in (1.0, 0.5, 0.25, 0.1, 0.03) if loss(w + a * (new - w)) < loss(w)), 0)
        if not part:
            break
        w = w + part * (new - w)
    return w


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Logistic weights of the label on the margins, none below zero, and a constant: projected Newton steps."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    a = np.array([2.0, 1.0, 1.0, 0.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        g = z.T @ (weight * (p - y)) + ridge * a * [1, 1, 1, 0]
        q = weight * p * (1 - p) + 1e-9
        d = np.linalg.solve((z * q[:, None]).T @ z + np.diag([ridge, ridge, ridge, 1e-6]), g)
        new = a - np.clip(d, -1, 1)
        new[:3] = np.maximum(new[:3], 0.0)
        if np.abs(new - a).max() < 1e-7:
            break
        a = new
    return a


def train(documents: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS, max_chars: int = MAX_CHARS) -> Model | None:
    """Fit on at most per_class (clean, toxic) labelled texts, none of a held-out id; None without both classes or without
    any unit that sets them apart."""
    return fit(labelled_sample(documents, labels, "toxic", per_class, max_chars))


def scores(model: Model | None, texts: list[bytes]) -> np.ndarray:
    return np.zeros(len(texts)) if model is None else model.score(model.best([t.decode("utf-8", "replace") for t in texts]))


def score_toxicity(documents: DataFrame, model: Model | None, at: float = PREDICT_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, from the text alone: from the windows of the greatest margins
    among all its sentences.

    Null and empty texts, and texts without a window of three letters, get the score of three margins of NO_UNIT. Without
    a model every score is 0. Null or repeated ids: a row each. Extra columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            s = scores(shared.value, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= at).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = documents.select("doc_id", held_out().alias("held_out"), "text")
    return map_texts(own, run, typed(own.drop("text"), "score double, predicted int"))


def drop_toxic(documents: DataFrame, model: Model | None, at: float = PREDICT_AT) -> DataFrame:
    """The rows of documents that score under `at`, columns as they are; decided row by row, so ids may repeat or be null."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            yield batch.filter(pa.array(scores(shared.value, texts) < at))

    return map_texts(documents, run, documents.schema)
