"""Adjacent agglomeration of a sequence: a linked list of runs, and a heap of neighbouring pairs by similarity."""

from __future__ import annotations

import heapq
import re

_TOKEN = re.compile(r"'((?:[^'])*)'|\"((?:\\.|[^\"\\])*)\"|(&&|\|\||[|;<>]|\d?>&\d|&)|([^\s'\";|&<>]+)|(\s+)|(.)", re.S)
#: Values made afresh for each call: times, epochs, universally unique ids and random names of temporary files.
_FRESH = tuple(
    (re.compile(p), r)
    for p, r in (
        (r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?(?:Z|[+-]\d\d:?\d\d)?", "<time>"),
        (r"(?<![\w:])\d\d:\d\d:\d\d(?:[.,]\d+)?(?![\w:])", "<time>"),
        (r"(?<![0-9A-Za-z])1[5-9]\d{8}(?:\d{3}|\d{6})?(?![0-9A-Za-z])", "<epoch>"),
        (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<id>"),
        (r"(/(?:var/)?tmp/[\w./-]*?[_.-])(?=[0-9a-f]*\d)[0-9a-f]{5,}(?![0-9A-Za-z])", r"\1<id>"),
        (r"(/(?:var/)?tmp/[\w./-]*?[_.-])[0-9a-f]{6,}(?![0-9A-Za-z])", r"\1<id>"),
    )
)
_OPERATORS = ("&&", "||", "|", ";", "<", ">", "&")


#: Actions come back; a plain dict, as this module is sent by value.
_words: dict[str, tuple[str, ...]] = {}
KEPT = 200_000


def canonical(action: str | None) -> tuple[str, ...]:
    """The words of an action, apart from quotes, blanks, comments, the order of its long options and values made afresh."""
    found = _words.get(action or "")
    if found is None:
        if len(_words) >= KEPT:
            _words.clear()
        found = _words[action or ""] = _canonical(action)
    return found


def _canonical(action: str | None) -> tuple[str, ...]:
    words: list[str] = []
    word: str | None = None
    text = action or ""
    i = 0
    while i < len(text):
        if text[i] == "#" and word is None:
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
            continue
        m = _TOKEN.match(text, i)
        i = m.end()
        single, double, op, plain, space, other = m.groups()
        if space is not None:
            if word is not None:
                words.append(word)
                word = None
        elif op is not None:
            if word is not None:
                words.append(word)
                word = None
            words.append("\x00" + op)
        else:
            piece = single if single is not None else re.sub(r"\\(.)", r"\1", double) if double is not None else plain if plain is not None else other
            word = (word or "") + piece
    if word is not None:
        words.append(word)
    while words and words[-1] == "\x00;":
        words.pop()
    out: list[str] = []
    command: list[str] = []
    for w in [*words, "\x00end"]:
        if w[0:1] == "\x00" and w[1:] in (*_OPERATORS, "end"):
            out += _ordered(command)
            command = []
            if w != "\x00end":
                out.append(w)
        else:
            command.append(w)
    return tuple(out)


def _ordered(command: list[str]) -> list[str]:
    """A simple command with its long options, each with the values that follow, in order of their names."""
    plain: list[str] = []
    options: list[list[str]] = []
    for w in command:
        for pattern, by in _FRESH:
            w = pattern.sub(by, w)
        if len(w) > 2 and w.startswith("--"):
            name, eq, value = w.partition("=")
            options.append([name, value] if eq and name.replace("-", "").replace("_", "").isalnum() else [w])
        elif options:
            options[-1].append(w)
        else:
            plain.append(w[2:] if w.startswith("./") and len(w) > 2 else w)
    return plain + [w for o in sorted(options) for w in o]


#: Similarity from which two actions are the same apart from how they are written and from values made afresh.
SAME = 0.95


def raw_words(action: str | None) -> tuple[str, ...]:
    return tuple((action or "").split())


def similarity(a: tuple[tuple[str, ...], str], b: tuple[tuple[str, ...], str]) -> float:
    """Of two actions, each as (canonical words, text): 1 for equal texts; from SAME up to 1 where only the writing or values made
    afresh differ, by the share of words that are equal as written; below SAME by the share of equal canonical words at equal places (Dice)."""
    if a[1] == b[1]:
        return 1.0
    if a[0] == b[0]:
        x, y = raw_words(a[1]), raw_words(b[1])
        n = sum(p == q for p, q in zip(x, y))
        return SAME + (1 - SAME) * 0.99 * (2.0 * n / (len(x) + len(y)) if x or y else 1.0)
    n = sum(p == q for p, q in zip(a[0], b[0]))
    return SAME * 0.99 * 2.0 * n / (len(a[0]) + len(b[0]))


def agglomerate(groups: list, actions: list[tuple[tuple[str, ...], str]], starts: list, ends: list, least: float, max_gap: float | None) -> list[tuple[int, int]]:
    """(first, last) index of each run after merging, again and again, the most similar neighbouring runs.

    Runs may merge when their groups (tool and status) are equal, their similarity is at least ``least`` and the time
    between them is at most ``max_gap``. A run's action is that of its first call. Ties go to the earliest pair.
    """
    n = len(groups)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    last = list(range(n))
    alive = [True] * n
    stamp = [0] * n

    def near(i: int) -> float:
        j = after[i]
        if j >= n or groups[i] != groups[j]:
            return -1.0
        if max_gap is not None:
            a, b = ends[last[i]], starts[j]
            if a is not None and b is not None and b - a > max_gap:
                return -1.0
        s = similarity(actions[i], actions[j])
        return s if s >= least else -1.0

    heap = [(-s, i, 0) for i in range(n) if (s := near(i)) >= 0]
    heapq.heapify(heap)
    while heap:
        _, i, at = heapq.heappop(heap)
        if not alive[i] or stamp[i] != at:
            continue
        j = after[i]
        alive[j] = False
        last[i] = last[j]
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        stamp[i] += 1
        if (s := near(i)) >= 0:
            heapq.heappush(heap, (-s, i, stamp[i]))
        p = before[i]
        if p >= 0:
            stamp[p] += 1
            if (s := near(p)) >= 0:
                heapq.heappush(heap, (-s, p, stamp[p]))
    return [(i, last[i]) for i in range(n) if alive[i]]
