"""The lines of scanned texts as a hidden Markov model: header, page number, body, and body that begins a paragraph."""

from __future__ import annotations

import re

import numpy as np
import regex

_NUMBER = regex.compile(r"^(?P<lead>\s*)(?P<open>[-–—\[(]\s?|p\.\s?|page\s|seite\s)?(?P<n>[0-9lIOoSB|]{1,5}|[ivxlcIVXLC1]{1,8})(?P<of>\s?/\s?[0-9lIOoSB|]{1,5})?(?P<close>\s?[-–—\])])?\s*$", regex.I)
NUMBERED = regex.compile(r"^\s*(?:[0-9lIO|]{1,5}|[ivxlc]{1,7})\s{3,}(?P<t>\S.*)$|^(?P<t>\S.*?)\s{2,}[|]\s{2,}\S{1,7}\s*$")
CHAPTER = regex.compile(r"^\s*\w{2,3}[.,|]?.?\s?[0-9lIO|]{1,3}\s[·.~^|]\s")
HEADING = regex.compile(r"^\s*(?:§\s?)?(?:[0-9]+(?:[.][0-9]+)*|[A-Z](?:[.][0-9]+)+)[.:]?\s\p{L}")
_PARTED = regex.compile(r"\s[—–|·]\s")
_PLAIN = re.compile(r"(?:^|\s)[a-zß-ÿ]\w{3,}.*?\s[a-zß-ÿ]\w{3,}")
_LETTERS = regex.compile(r"[^\p{L} ]+")
_DIGITS = str.maketrans("lIOoSB|", "1100581")
#: Characters of the longest page number that _NUMBER can match, blanks at the ends aside.
_LONGEST_NUMBER = 24
#: A running header is a line of at most so many words.
HEADER_WORDS = 24
#: Share of the lines with a symbol that its prior counts for in the fit; rounds of the fit at most, change that ends it.
PRIOR, ROUNDS, SETTLED = 1.0, 40, 1e-4

#: Lines below which a sample is too small to learn from, and the prior stands.
FEWEST = 1_000

H, N, B = range(3)
#: Log-odds of a look that a label can't have: only a marked number is a page number, only a line with traits a header.
NEVER = -30.0
#: Symbols of a line's look: plain body, a bare and a marked number, then combinations of a possible header's traits.
PLAIN_LOOK, BARE, MARKED, TRAITS = 0, 1, 2, 3
LOOKS = TRAITS + 3 * 4 * 32
#: Sizes of the features that tell whether a body line begins a paragraph: the line before, its own start, indent, kind.
STARTS = (4, 4, 2, 4)


def roman(text: str) -> int:
    value, last = 0, 0
    for ch in reversed(text.lower()):
        v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}.get(ch, 0)
        value += v if v >= last else -v
        last = max(last, v)
    return value


def page_number(line: str) -> tuple[bool, int, bool] | None:
    """(marked as a page number by its form, value, roman) of a line that is only a number, else None."""
    m = _NUMBER.match(line)
    if not m:
        return None
    n = m["n"]
    marked = bool(m["open"] and (m["close"] or m["open"][0] in "pPsS") or m["of"] or len(m["lead"]) >= 3)
    if n.lower().strip("ivxlc") == "" and not (n.lower().strip("l") == "" and "l" in n):
        return marked, roman(n), True
    digits = n.translate(_DIGITS)
    if not digits.isdigit():
        return (marked, roman(n.replace("1", "i")), True) if marked else None
    return marked, int(digits), False


def header_keys(line: str) -> list[str]:
    """Keys of a line that could be a running header: its letters without page numbers, and with each word left out;
    after them, marked, the parts of a line that is parted by a dash or bar."""
    text = line.strip()
    if len(text) < 5 or text[-1] in ".;,?!" or HEADING.match(line) and not NUMBERED.match(line):
        return []
    m = NUMBERED.match(line)
    words = [w for w in _LETTERS.sub("", (m["t"] if m else text).lower()).split() if len(w) > 1]
    if not 1 < len(words) <= HEADER_WORDS:
        return []
    keys = [" ".join(words)]
    if len(words) > 2:
        keys += [" ".join([*words[:k], "*", *words[k + 1 :]]) for k in range(len(words))]
    parts = _PARTED.split(text)
    if len(parts) > 1:
        keys += ["= " + p for part in parts if " " in (p := " ".join(w for w in _LETTERS.sub("", part.lower()).split() if len(w) > 1))]
    return keys


def _traits(line: str, known) -> int:
    """The symbol of a possible header: how it is known as one, its case, and five marks of form."""
    m = NUMBERED.match(line)
    text = (m["t"] if m else line).strip()
    if len(text) < 4:
        return PLAIN_LOOK
    keys = header_keys(line)
    key = 2 if keys and known(keys[0]) else 1 if any(known(k) for k in keys[1:]) else 0
    letters = [c for c in text if c.isalpha()]
    words = [w for w in text.split() if len(w) > 3 and w[0].isalpha()]
    high = sum(w[0].isupper() for w in words)
    if letters and sum(c.isupper() for c in letters) > 0.8 * len(letters) and len(letters) > 6:
        case = 3
    elif words and high == len(words) > 1:
        case = 2
    else:
        case = int(high >= 0.6 * len(words))
    bits = (m is not None, CHAPTER.match(line) is not None, text[-1] in ".;,?!" or text[0].islower(), m is None and HEADING.match(line) is not None, text[0] in "[(")
    return TRAITS + (key * 4 + case) * 32 + sum(b << i for i, b in enumerate(bits))


def looks(lines: list[str], known, whole_page: bool) -> tuple[list[int], dict[int, tuple[int, bool]]]:
    """The symbol of each line's look, and (value, roman) of the lines that are a bare number.

    In a whole page a header is looked for at the top, at the bottom and beside a number; in a paragraph anywhere.
    """
    last = len(lines) - 2
    out, bare, numbered = [], {}, False
    for k, line in enumerate(lines):
        n = page_number(line) if len(line) <= _LONGEST_NUMBER or line[0].isspace() or line[-1].isspace() else None
        if n:
            out.append(MARKED if n[0] else BARE)
            if not n[0]:
                bare[k] = (n[1], n[2])
        elif (not whole_page or k < 2 or k >= last or numbered) and len(line) > 4 and line[-1] != "." and not _PLAIN.search(line):
            # two longer words in lower case are a sentence's, whatever else a line is like
            out.append(_traits(line, known))
        else:
            out.append(PLAIN_LOOK)
        numbered = n is not None
    return out, bare


def starts(lines: list[str]) -> list[tuple[int, int, int, int]]:
    """What tells whether each of a text's body lines begins a paragraph: how the line before it ends (0 none, 1 a
    heading, a formula, or a sentence's end well before the margin, 2 a sentence's end, 3 neither), its first character (0 lower case, 1 upper, 2
    digit, 3 other), whether it is indented, and whether it or the one before is a heading or formula."""
    width = max((len(x.rstrip()) for x in lines), default=0)
    out, before, was = [], 0, 0
    for line in lines:
        text = line.strip()
        first = text[:1]
        alone = int(sum(map(str.isalpha, text)) < 0.4 * len(text) or HEADING.match(line) is not None)
        out.append((before, 0 if first.islower() else 1 if first.isupper() else 2 if first.isdigit() else 3, int(line[:1] in " \t"), was * 2 + alone))
        ended = text[-1:] in ".?!" or text[-2:] in ('."', ".”", ".)", "?”", "!”")
        before, was = (1 if alone or len(line.rstrip()) < 0.85 * width else 2) if ended or alone else 3, alone
    return out


class LineModel:
    """A hidden Markov model of lines, as tables of logarithms.

    The hidden labels are header, page number, body and break, a break being body that begins a paragraph. Body and
    break share their transitions and looks and differ in four features, so lines are decoded over three states, and
    body lines then by the features. :meth:`prior` states what is known beforehand; :meth:`fit` estimates all tables by
    Baum and Welch's method, the prior counting for a share of the lines that bear a symbol. Paragraphs and whole pages
    have steps and beginnings of their own (the first index of both tables).
    """

    def __init__(self, look: np.ndarray, step: np.ndarray, begin: np.ndarray, starts: list[np.ndarray], share: float):
        self.look, self.step, self.begin, self.starts, self.share = look, step, begin, starts, share
        self._tables = None

    @staticmethod
    def prior_odds() -> np.ndarray:
        """Log-odds of each look under header and number against body, before any line is seen."""
        odds = np.full((LOOKS, 3), NEVER)
        odds[:, B] = 0.0
        odds[MARKED, N] = 5.0  # a bare number is the page's own or not by the number itself, which is not for the lines to tell
        s = np.arange(LOOKS - TRAITS)
        key, case, bit = s // 128, s // 32 % 4, lambda i: s >> i & 1
        odds[TRAITS:, H] = -4 + np.array([0, 5, 6])[key] + np.array([-6, 0, 3, 4])[case] + 5 * bit(0) + 4 * bit(1) - 5 * bit(2) - 4 * bit(4)
        odds[TRAITS:, H][bit(3) == 1] = NEVER  # a numbered heading is text
        return odds

    @classmethod
    def prior(cls) -> LineModel:
        begin = np.array([[0.5, -0.5, 0.0], [1.5, -0.5, 0.0]])
        step = np.array([[[-5.0, -1.5, 0.0], [2.0, -3.0, 0.0], [-1.0, -0.5, 0.0]]] * 2)
        tables = [np.log(np.array(t)) for t in (
            [[0.01, 0.02, 0.19, 0.78], [0.3, 0.55, 0.1, 0.05]], [[0.7, 0.2, 0.05, 0.05], [0.05, 0.75, 0.1, 0.1]],
            [[0.9, 0.1], [0.7, 0.3]], [[0.91, 0.03, 0.03, 0.03], [0.6, 0.15, 0.15, 0.1]],
        )]
        return cls(cls.prior_odds(), step, begin, tables, 0.2)

    def fit(self, texts: list[tuple[int, np.ndarray, np.ndarray]]) -> LineModel:
        """The model that fits ``texts`` (1 for a whole page, looks, four start features a line) best, from the prior on."""
        alike: dict[tuple[int, int], list] = {}
        for page, x, s in texts:
            if len(x):
                alike.setdefault((page, len(x)), []).append((x, s))
        if sum(n * len(some) for (_, n), some in alike.items()) < FEWEST:
            return self
        blocks = [(page, np.stack([x for x, _ in some]), np.stack([s for _, s in some])) for (page, _), some in sorted(alike.items())]
        count = np.bincount(np.concatenate([x.ravel() for _, x, _ in blocks]), minlength=LOOKS).astype(float)
        weight = PRIOR * count + 1.0
        odds = self.prior_odds()
        guess = weight[:, None] * np.exp(odds - odds.max(1, keepdims=True)) / np.exp(odds - odds.max(1, keepdims=True)).sum(1, keepdims=True)
        model, last = LineModel(odds, self.step, self.begin, self.starts, self.share), -np.inf
        for _ in range(ROUNDS):
            total, seen, step, begin = 0.0, np.zeros((LOOKS, 3)), np.ones((2, 3, 3)), np.ones((2, 3))
            kinds, body = [np.ones((2, n)) for n in STARTS], np.zeros(2)
            for page, x, s in blocks:
                gamma, pairs, fit = model._posterior(x, page)
                total += fit
                np.add.at(seen, x.ravel(), gamma.reshape(-1, 3))
                begin[page] += gamma[:, 0].sum(0)
                step[page] += pairs
                new = model._breaks(s)[..., None] * gamma[..., B, None]
                two = np.concatenate([gamma[..., B, None] - new, new], -1).reshape(-1, 2)
                body += two.sum(0)
                for f, table in enumerate(kinds):
                    for c in (0, 1):
                        table[c] += np.bincount(s[..., f].ravel(), two[:, c], STARTS[f])
            look = np.where(odds > NEVER, seen + guess + 1e-3, 0.0)  # what can't be stays so, however few lines a label has
            norm = lambda t: np.log(t / t.sum(-1, keepdims=True))
            table = np.where(look > 0, np.log(np.maximum(look, 1e-300) / look.sum(0)), 2 * NEVER)
            model = LineModel(table, norm(step), norm(begin), [norm(t) for t in kinds], float(body[1] / max(body.sum(), 1e-9)))
            if abs(total - last) <= SETTLED * abs(total):
                break
            last = total
        return model

    def _posterior(self, x: np.ndarray, page: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Forward and backward over texts of equal length: label probabilities, expected steps, log-likelihood."""
        e = self.look[x]
        top = e.max(-1, keepdims=True)
        e, a, start = np.exp(e - top), np.exp(self.step[page]), np.exp(self.begin[page])
        a, start = a / a.sum(1, keepdims=True), start / start.sum()
        n, t = x.shape
        forward, scale = np.empty((n, t, 3)), np.empty((n, t))
        for k in range(t):
            f = (start if k == 0 else forward[:, k - 1] @ a) * e[:, k]
            scale[:, k] = f.sum(1)
            forward[:, k] = f / scale[:, k, None]
        backward, pairs = np.ones((n, 3)), np.zeros((3, 3))
        gamma = np.empty_like(forward)
        for k in range(t - 1, -1, -1):
            gamma[:, k] = forward[:, k] * backward
            gamma[:, k] /= gamma[:, k].sum(1, keepdims=True)
            if k:
                right = e[:, k] * backward / scale[:, k, None]
                pairs += a * np.einsum("ni,nj->ij", forward[:, k - 1], right)
                backward = right @ a.T
        return gamma, pairs, float(np.log(scale).sum() + top.sum())

    def _breaks(self, s: np.ndarray) -> np.ndarray:
        """The probability that a body line with each set of start features begins a paragraph."""
        odds = np.log(self.share) - np.log1p(-self.share)
        for f, table in enumerate(self.starts):
            odds = odds + (table[1] - table[0])[s[..., f]]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def tables(self) -> tuple:
        if self._tables is None:
            self._tables = ([tuple(r) for r in self.look.tolist()], [[tuple(r) for r in t.T.tolist()] for t in self.step], [tuple(t) for t in self.begin.tolist()])
        return self._tables

    def labels(self, looks_: list[int], page: bool) -> str:
        """The likeliest labels (h, n, b) of a text's lines, by Viterbi's method. A text of plain lines only is all body."""
        if not any(looks_):
            return "b" * len(looks_)
        look, steps, begins = self.tables()
        (to_h, to_n, to_b), (h, n, b) = steps[page], begins[page]
        back: list[tuple[int, int, int]] = []
        for k, x in enumerate(looks_):
            e = look[x]
            if k:
                rows = ((h + to_h[0], n + to_h[1], b + to_h[2]), (h + to_n[0], n + to_n[1], b + to_n[2]), (h + to_b[0], n + to_b[1], b + to_b[2]))
                best = tuple(map(max, rows))
                back.append(tuple(r.index(m) for r, m in zip(rows, best)))
                h, n, b = best
            h, n, b = h + e[0], n + e[1], b + e[2]
        at = max((h, 0), (n, 1), (b, 2))[1]
        out = ["hnb"[at]]
        for step in reversed(back):
            at = step[at]
            out.append("hnb"[at])
        return "".join(reversed(out))

    def breaks(self, body: list[str]) -> list[bool]:
        """Which of the body lines of a text begin a paragraph; the first does."""
        if not body:
            return []
        got = self._breaks(np.array(starts(body), np.int64)) > 0.5
        got[0] = True
        return got.tolist()
