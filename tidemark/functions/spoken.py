"""Captions against the speech around them (J5): was a shown text only read out?

Speech is searched in windows of words somewhat longer than the caption; the score of a window is the best of four
likenesses (fuzzy.caption_similarity). The best ratio of the caption with any stretch of the window comes from the
common subsequences of the caption with all stretches of the speech, which one pass over caption and speech gives: a
strand starts above each place of the speech, and of two that meet the later one goes on downwards, unless the
characters are equal. The common subsequence with a stretch has as many characters as strands end in it that started
before it. What is left, the words of windows in other orders, is compared for many windows at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate
from math import ceil

import numpy as np

from tidemark.functions import fuzzy, phrases

#: Words a window has more than the caption, at least, and in proportion; windows of window_starts at most, besides the last.
SLACK, SCALE, WINDOWS = 4, 1.6, 60
#: A caption of fewer characters or words is not compared; from this score on it is derived from speech.
LEAST_CHARS, LEAST_WORDS, DERIVED = 8, 2, 85
#: Rows, pairs of texts, numbers and characters that are worked on at once.
ROWS, PAIRS, NUMBERS, CHARS = 32, 2048, 1 << 21, 1 << 24


def window_size(words: int) -> int:
    return max(max(1, words) + SLACK, round(max(1, words) * SCALE))


def window_starts(words: int, size: int) -> list[int]:
    """Starts of windows of `size` of so many words: evenly spaced, with the last one."""
    if words <= size:
        return [0] if words else []
    positions = words - size + 1
    return sorted({*range(0, positions, max(1, ceil(positions / WINDOWS))), positions - 1})


def every_start(words: int, size: int) -> list[int]:
    """Starts of all windows of `size` of so many words."""
    return list(range(max(1, words - size + 1))) if words else []


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def strands(pairs: Sequence[tuple[str, str]]) -> list[np.ndarray]:
    """For each pair (a, b) and each place of b, the place over which the strand that ends there starts, or -1 if it comes from the side.

    lcs(a, b[i:j]) is the number of places from i to j whose strand starts before i. All pairs go side by side, one
    diagonal of their tables after the other.
    """
    m, n = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    a, b = ([_codes(p[k]) for p in pairs] for k in (0, 1))
    small = n < 32_767 and max(int(x.max(initial=0)) for x in (*a, *b)) < 65_534
    signed, plain = (np.int16, np.uint16) if small else (np.int32, np.uint32)
    most, one = np.iinfo(signed).max, plain(1)
    chars, side = np.full((m, len(pairs)), np.iinfo(plain).max, plain), np.full((m, len(pairs)), -2, signed)
    over, down = np.full((n + 2 * m, len(pairs)), np.iinfo(plain).max - 1, plain), np.full((n + 2 * m, len(pairs)), most, signed)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        chars[: len(x), k], side[: len(x), k] = x, -1
        at = slice(m + n - len(y), m + n)  # the last place of b first
        over[at, k], down[at, k] = y[::-1], np.arange(len(y) - 1, -1, -1)
    same, high, swap = np.empty_like(chars), np.empty_like(side), np.empty_like(side)
    equal = same.view(signed)
    for s in range(n + m - 1, 0, -1):
        d = down[s : s + m]
        np.bitwise_xor(chars, over[s : s + m], out=same)
        np.minimum(same, one, out=same)
        np.subtract(same, one, out=same)  # all bits where characters are equal
        np.maximum(d, side, out=high)
        np.bitwise_xor(high, side, out=swap)
        np.bitwise_and(swap, equal, out=swap)
        np.bitwise_xor(high, swap, out=high)
        np.bitwise_xor(side, d, out=side)
        np.bitwise_xor(side, high, out=side)
        d[:] = high
    return [down[m + n - len(y) : m + n, k][::-1].astype(np.int64) for k, y in enumerate(b)]


def _laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, the number of the text of each, and its place there."""
    sizes = np.array([len(t) for t in texts])
    of = np.repeat(np.arange(len(texts)), sizes)
    return _codes("".join(texts)), of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def common(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """fuzzy.lcs of each pair: many at once, 63 places of the first text in a number and the carry of its sums in the last bit."""
    out = np.zeros(len(pairs), np.int64)
    if not pairs:
        return out
    letters = np.unique(_codes("".join({a for a, _ in pairs})))
    width = len(letters) + 1
    table = np.zeros(int(max(letters.max(initial=0), _codes("".join({b for _, b in pairs})).max(initial=0))) + 1, np.int64)
    table[letters] = np.arange(1, width)
    order = sorted(range(len(pairs)), key=lambda k: (-(-len(pairs[k][0]) // 63), len(pairs[k][1])))
    low, top = np.uint64((1 << 63) - 1), np.uint64(63)
    while order:
        limbs = max(1, -(-len(pairs[order[-1]][0]) // 63))
        some = order[-max(1, min(PAIRS, NUMBERS // (limbs * width))) :]
        del order[-len(some) :]
        firsts = {a: i for i, a in enumerate(dict.fromkeys(pairs[k][0] for k in some))}
        chars, of, at = _laid(list(firsts))
        masks = np.zeros((limbs, len(firsts) * width), np.uint64)
        np.bitwise_or.at(masks, (at // 63, of * width + table[chars]), np.left_shift(np.uint64(1), (at % 63).astype(np.uint64)))
        chars, of, at = _laid([pairs[k][1] for k in some])
        steps = np.zeros((int(at.max(initial=-1)) + 1, len(some)), np.int64)
        steps[at, of] = table[chars]
        steps += np.array([firsts[pairs[k][0]] for k in some]) * width
        state = np.full((limbs, len(some)), low)
        u, carry = np.empty(len(some), np.uint64), np.empty(len(some), np.uint64)
        for step in steps:
            carry[:] = 0
            for v, mask in zip(state, masks, strict=True):
                mask.take(step, out=u, mode="clip")
                np.bitwise_and(u, v, out=u)
                np.add(carry, v, out=carry)
                np.add(carry, u, out=carry)
                np.bitwise_xor(v, u, out=v)
                np.bitwise_or(v, carry, out=v)
                np.bitwise_and(v, low, out=v)
                np.right_shift(carry, top, out=carry)
        out[some] = 63 * limbs - np.bitwise_count(state).sum(axis=0, dtype=np.int64)
    return out


def _whole(x: np.ndarray | float, n: np.ndarray | float) -> np.ndarray:
    """The whole-number ratio of x common characters, of n in all."""
    return (200.0 * np.asarray(x) / n).astype(np.int64)


class _Stretches:
    """Common subsequences of a caption of n characters with stretches of one speech, by its strands."""

    def __init__(self, n: int, start: np.ndarray):
        self.n, self.start, size = n, start, len(start)
        inside = np.flatnonzero(start >= 0)
        self.end = np.full(size, size)
        self.end[start[inside]] = inside
        # a strand within a stretch of n is a character that the stretch has more than the common subsequence
        first, last = np.maximum(inside - n + 1, 0), start[inside]
        on = first <= last
        more = np.bincount(first[on], minlength=size + 1) - np.bincount(last[on] + 1, minlength=size + 1)
        self.whole = _whole(n - np.cumsum(more)[: max(0, size - n + 1)], 2 * n)

    def lcs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each window from a to b."""
        return np.array([np.count_nonzero(self.start[x:y] < x) for x, y in zip(a, b, strict=True)], np.int64)

    def best(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The best whole-number ratio with a stretch of each window from a to b of n characters or more: of n within it, or of fewer at its ends."""
        if not len(a):
            return np.zeros(0, np.int64)
        best = np.maximum.reduceat(np.append(self.whole, 0), np.stack([a, b - self.n + 1], axis=1).ravel())[::2]
        if self.n > 1:
            k, some = np.arange(self.n - 1), max(1, NUMBERS // self.n)
            for at in (slice(lo, lo + some) for lo in range(0, len(a), some)):
                x, y = a[at, None], b[at, None]
                head = np.cumsum(self.start[x + k] < x, axis=1)
                tail = k + 1 - np.cumsum(self.end[y - 1 - k] < y, axis=1)
                best[at] = np.maximum(best[at], _whole(np.maximum(head, tail), self.n + k + 1).max(axis=1))
        return best


def _plain_tokens(words: list[str]) -> bool:
    """Whether every run of the words is its own normalised text."""
    return all(w not in phrases._NUMBERS and phrases._plain(w) == [w] and w[-1] != "$" and w[0] != "%" for w in set(words))


def _matches(tokens: list[str], others: list[str], least: float) -> np.ndarray:
    """fuzzy.tokens_match of each of tokens with each of others, in one table; single numbers hold tokens of up to 63 characters."""
    n, m = np.array([len(t) for t in tokens])[:, None], np.array([len(t) for t in others])[None, :]
    found = np.zeros((len(tokens), len(others)), bool)
    long = [i for i, t in enumerate(tokens) if len(t) > 63], [j for j, t in enumerate(others) if len(t) > 63]
    if all(map(len, (tokens, others))):
        letters = {c: i for i, c in enumerate(dict.fromkeys("".join(tokens)), 1)}
        masks = np.zeros((len(tokens), len(letters) + 1), np.uint64)
        width = min(63, int(m.max()))
        code, chars = np.zeros((width, len(others)), np.int64), np.full((width, len(tokens)), -1)
        for i, t in enumerate(tokens):
            for j, c in enumerate(t[:63]):
                masks[i, letters[c]] |= np.uint64(1 << j)
            chars[: min(len(t), width), i] = [letters[c] for c in t[:width]]
        for j, t in enumerate(others):
            code[: min(len(t), width), j] = [letters.get(c, 0) for c in t[:width]]
        v, shared, still = np.full(found.shape, np.uint64((1 << 64) - 1)), np.zeros(found.shape, np.int64), np.ones(found.shape, bool)
        for c, own in zip(code, chars, strict=True):
            u = masks[:, c] & v
            v = (v + u) | (v - u)
            still &= own[:, None] == c[None, :]
            shared += still
        have, least_of = np.bitwise_count(~v).astype(np.int64), np.minimum(n, m)
        found = (200.0 * have / (n + m) >= least) | (shared >= 5) & (shared >= 0.6 * least_of)
    for i in range(len(tokens)):
        for j in range(len(others)) if i in long[0] else long[1]:
            found[i, j] = fuzzy.tokens_match(tokens[i], others[j], least)
    return found


def _recall(caption: str, words: list[str], starts: list[int], size: int, least: float, content: int) -> np.ndarray:
    """fuzzy.token_recall of each window; 0 if the caption has fewer than `content` content tokens."""
    tokens = list(dict.fromkeys(phrases.content_tokens(caption)))
    if not tokens or len(tokens) < content:
        return np.zeros(len(starts), np.int64)
    if _plain_tokens(words):
        kinds = {w: i for i, w in enumerate(dict.fromkeys(phrases.content_tokens(" ".join(dict.fromkeys(words)))))}
        none = len(kinds)
        held = np.append(_matches(tokens, list(kinds), least), np.zeros((len(tokens), 1), bool), axis=1)[:, [kinds.get(w, none) for w in words]]
        upto = np.append(np.zeros((len(tokens), 1), np.int64), np.cumsum(held, axis=1), axis=1)
        some = max(1, NUMBERS // len(tokens))
        pieces = [np.array(starts[lo : lo + some]) for lo in range(0, len(starts), some)]
        found = np.concatenate([(upto[:, np.minimum(at + size, len(words))] > upto[:, at]).sum(axis=0) for at in pieces])
    else:
        kinds, held, counts, some = {}, np.zeros((len(tokens), 0), bool), [], max(1, NUMBERS // (8 * size))
        for lo in range(0, len(starts), some):
            windows = [list(dict.fromkeys(phrases.content_tokens(" ".join(words[i : i + size])))) for i in starts[lo : lo + some]]
            new = [w for w in dict.fromkeys(w for ws in windows for w in ws) if w not in kinds]
            kinds |= {w: i for i, w in enumerate(new, len(kinds))}
            held = np.append(held, _matches(tokens, new, least), axis=1)
            counts += [int(held[:, [kinds[w] for w in ws]].any(axis=1).sum()) for ws in windows]
        found = np.array(counts)
    return np.array([round(100 * f / len(tokens)) for f in range(len(tokens) + 1)])[found]


def _contains(texts: tuple[str, str], words: list[str], starts: list[int], size: int, whole: _Stretches, close: _Stretches) -> tuple[np.ndarray, np.ndarray]:
    """fuzzy.contains_ratio of the caption with each window, and the ratio without white space; texts: the caption, and without white space."""
    first, last = np.array(starts), np.minimum(np.array(starts) + size, len(words))
    bare = np.array(list(accumulate(map(len, words), initial=0)))
    ends = bare + np.arange(len(bare))  # each word with one space
    sides = (whole, ends[first], ends[last] - 1), (close, bare[first], bare[last])
    ratios = [_whole(s.lcs(a, b), s.n + b - a) for s, a, b in sides]
    short = bare[last] - bare[first] < 0.8 * close.n  # too short to hold the caption: compared as a whole
    best = np.where(short, np.maximum(*ratios), 0)
    for (s, a, b), text, gap in zip(sides, texts, (" ", ""), strict=True):
        fits = ~short & (b - a >= s.n)
        best[fits] = np.maximum(best[fits], s.best(a[fits], b[fits]))
        for i in np.flatnonzero(~short & ~fits):
            best[i] = max(best[i], int(fuzzy.partial_ratio(text, gap.join(words[first[i] : last[i]]))))
    return best, ratios[1]


def best_windows(
    pairs: Sequence[tuple[str, str]], least: float = 80, content: int = 3, begin: Callable[[int, int], list[int]] = window_starts
) -> list[tuple[int, str, str] | None]:
    """(score, method, window) of the window of each speech that is most like its caption, the first of equals; all normalised. None without speech.

    Of the windows that `begin` gives for the words of a speech and a size: with every_start, of all.
    """
    out: list[tuple[int, str, str] | None] = [None] * len(pairs)
    split = [(c, "".join(c.split()), s.split()) for c, s in pairs]
    for k, (caption, bare, words) in enumerate(split):
        if words and not bare:  # nothing to look for
            size = window_size(0)
            texts = [" ".join(words[i : i + size]) for i in begin(len(words), size)]
            out[k] = max(((*fuzzy.caption_similarity(caption, t, least, content), t) for t in texts), key=lambda x: x[0])
    todo = sorted((k for k, (_, bare, words) in enumerate(split) if words and bare), key=lambda k: (len(pairs[k][1]) // 512, len(pairs[k][0])))
    for lo in range(0, len(todo), ROWS):
        some = todo[lo : lo + ROWS]
        whole = strands([(split[k][0], " ".join(split[k][2])) for k in some])
        close = strands([(split[k][1], "".join(split[k][2])) for k in some])
        jobs: list[tuple[str, str]] = []
        rows, done, chars = [], [], 0
        for k, w, c in zip(some, whole, close, strict=True):
            caption, bare, words = split[k]
            size = window_size(len(caption.split()))
            starts = begin(len(words), size)
            contains, single = _contains((caption, bare), words, starts, size, _Stretches(len(caption), w), _Stretches(len(bare), c))
            recall = _recall(caption, words, starts, size, least, content)
            own = caption.split()
            mine, ordered = set(own), " ".join(sorted(own))
            known = np.maximum(np.maximum(contains, single), recall)
            most, first = int(known.max()), int(known.argmax())
            parts = []
            for at, i in enumerate(starts):
                window = sorted(words[i : i + size])
                theirs, said = set(window), " ".join(window)
                both = " ".join(sorted(mine & theirs))
                left, right = " ".join(sorted(mine - theirs)), " ".join(sorted(theirs - mine))
                n, x, y, z = map(len, (both, left, right, said))
                l, r = n + (n > 0 < x) + x, n + (n > 0 < y) + y  # noqa: E741
                reach = max(int(200.0 * (n + (n > 0 < min(x, y)) + min(x, y)) / (l + r)), int(200.0 * min(len(ordered), z) / (len(ordered) + z)))
                asked = reach > most or reach == most and at <= first  # else another window is better, or as good and before it
                parts.append((n, x, y, z, asked))
                if not asked:
                    continue
                jobs += [(ordered, said), (left, right)]
                chars += x + y + z
                if chars >= CHARS:
                    done.append(common(jobs))
                    jobs, chars = [], 0
            rows.append((k, words, size, starts, contains, single, recall, np.array(parts)))
        lcs, at = np.concatenate([*done, common(jobs)]), 0
        for k, words, size, starts, contains, single, recall, parts in rows:
            both, left, right, lengths, asked = parts.T
            sort, rest = np.zeros((2, len(starts)), np.int64)
            n = 2 * int(asked.sum())
            sort[asked > 0], rest[asked > 0] = lcs[at : at + n : 2], lcs[at + 1 : at + n : 2]
            at += n
            gap_l, gap_r = (both > 0) & (left > 0), (both > 0) & (right > 0)
            l, r = both + gap_l + left, both + gap_r + right  # noqa: E741
            sets = np.maximum(_whole(both + (gap_l & gap_r) + rest, l + r), np.where(both > 0, np.maximum(_whole(both, both + l), _whole(both, both + r)), 0))
            ordered = _whole(sort, len(" ".join(sorted(split[k][0].split()))) + lengths)
            scores = np.array([contains, np.maximum(sets, single), ordered, recall])
            first = int(scores.max(axis=0).argmax())
            best = int(scores[:, first].max())
            method = ("contains", "token_set", "token_sort", "token_recall")[int(scores[:, first].argmax())]
            out[k] = best, method, " ".join(words[starts[first] : starts[first] + size])
    return out


def best_window(caption: str, speech: str, least: float = 80, content: int = 3) -> tuple[int, str, str] | None:
    """best_windows of one caption, of all windows."""
    return best_windows([(caption, speech)], least, content, every_start)[0]
