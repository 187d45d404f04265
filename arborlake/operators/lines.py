"""Level 1 on Arrow columns of the lines of many sentences: lines, columns, white space, ids.

A line is judged by itself, by the line of a node before it, and by what its sentence has in all. Ids are read once for
each different one; only lines of nodes with white space or empty cells are looked at one by one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from arborlake.operators.sentence import RANGE, WORD
from arborlake.sources.cells import firsts, split

# White space but the line feed (Unicode's), and ids. A node's line begins with a digit of any script.
_OTHERS = r"\x0b-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = r"[\t\x0b-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACED, LEADING, TRAILING, REPEATED = (re.compile(p) for p in (SPACE, rf"\A{SPACE}", rf"{SPACE}\Z", SPACE * 2))
EMPTY, NUMBER = re.compile(r"(0|[1-9][0-9]*)\.([1-9][0-9]*)"), re.compile(r"[+-]?[0-9]+")
WORDS, RANGES, EMPTIES, OTHER = range(4)
#: Stands for a number that is missing, or that no int holds.
NONE = -(1 << 60)


def number(text: str) -> int:
    """As a cast to int reads it."""
    text = text.strip("".join(map(chr, (*range(33), *range(127, 160)))))
    n = int(text) if NUMBER.fullmatch(text) else NONE
    return n if -(1 << 31) <= n < 1 << 31 else NONE


def read(name: str) -> tuple[int, int, int]:
    """Kind, begin and end of an id."""
    kind = WORDS if WORD.fullmatch(name) else RANGES if RANGE.fullmatch(name) else EMPTIES if EMPTY.fullmatch(name) else OTHER
    return kind, number(name.split("-")[0].split(".")[0]), number(name.rsplit("." if "." in name else "-", 1)[-1])


def of_cells(line: str) -> Iterator[str]:
    """What the white space of a line of ten cells breaks."""
    cells = line.split("\t")
    for i, cell in enumerate(cells):
        spaced = SPACED.search(cell)
        if spaced and i in (1, 2) and "-" in cells[0]:
            yield "invalid-whitespace-mwt"
        elif spaced and i in (0, 3, 4, 5, 6, 7, 8):
            yield "invalid-whitespace"
        elif not cell:
            yield "empty-column"
        else:
            yield from (t for t, p in (("leading-whitespace", LEADING), ("trailing-whitespace", TRAILING), ("repeated-whitespace", REPEATED)) if p.search(cell))


def blank(line: pa.Array, first: np.ndarray) -> np.ndarray:
    at = np.flatnonzero((first <= 0x20) | (first >= 0x80))
    out = np.zeros(len(line), bool)
    out[at] = np.asarray(pc.match_substring_regex(line.take(pa.array(at)), rf"^[\t{_OTHERS}]*$"))
    return out


def found(raw: pa.Array) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Test, number of the sentence and of the line, of all that is broken; a null has no lines."""
    of, line = split(raw, "\n")
    many = len(raw)
    if not len(of):
        return
    begin = np.searchsorted(of, np.arange(many))
    number_of = np.bincount(of, minlength=many)
    at = np.arange(len(of)) - begin[of] + 1
    first = firsts(line)
    comment, node = first == ord("#"), (first >= ord("0")) & (first <= ord("9"))
    far = np.flatnonzero(first >= 0x80)
    node[far] = [unicodedata.category(t[0]) == "Nd" for t in line.take(pa.array(far)).to_pylist()]
    empty, last = blank(line, first), at == number_of[of]
    places = np.flatnonzero(node)
    nodes, n_of = line.filter(pa.array(node)), of[places]
    start = np.full(many, 1 << 30)
    np.minimum.at(start, of[~comment], at[~comment])

    hit = lambda test, mask: (test, of[mask], at[mask])
    yield hit("misplaced-comment", comment & (at > start[of]))
    yield hit("pseudo-empty-line", empty & (first != 0))  # the byte of an empty line is 0, and no white space is
    yield hit("extra-empty-line", empty & ~last)
    yield hit("empty-sentence", empty & last & (np.bincount(n_of, minlength=many)[of] == 0))
    yield hit("invalid-line", ~comment & ~empty & ~node)
    yield hit("missing-empty-line", last & ~empty)

    width = np.asarray(pc.count_substring(nodes, "\t"), dtype=np.int64) + 1
    told = lambda test, mask: (test, n_of[mask], at[places[mask]])
    yield told("number-of-columns", width != 10)
    likely = pc.or_(pc.match_substring_regex(nodes, f"[{_OTHERS}]"), pc.or_(pc.match_substring(nodes, "\t\t"), pc.ends_with(nodes, "\t")))
    spaced = np.flatnonzero(np.asarray(likely) & (width == 10))
    broken: dict[str, list[int]] = {}
    for i, text in zip(spaced.tolist(), nodes.take(pa.array(spaced)).to_pylist()):
        for test in of_cells(text):
            broken.setdefault(test, []).append(i)
    for test, where in broken.items():
        yield told(test, np.array(where, np.int64))
    yield from _of_ids(pc.list_element(pc.split_pattern(nodes, "\t", max_splits=1), 0), n_of, many, told, start, begin, at, places)


def _of_ids(names: pa.Array, n_of: np.ndarray, many: int, told: Callable, start: np.ndarray, begin: np.ndarray, at: np.ndarray, places: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    known = names.dictionary_encode()
    kind, a, b = np.array([read(x) for x in known.dictionary.to_pylist()], np.int64).reshape(-1, 3)[np.asarray(known.indices, dtype=np.int64)].T
    there = lambda *numbers: np.logical_and.reduce([x > NONE for x in numbers])
    word, ranged, empty = kind == WORDS, kind == RANGES, kind == EMPTIES
    yield told("invalid-word-id", kind == OTHER)

    count = np.bincount(n_of[word], minlength=many)
    w_of = n_of[word]
    nth_word = np.arange(len(w_of)) - np.searchsorted(w_of, w_of) + 1
    wrong = np.flatnonzero(np.bincount(w_of[a[word] != nth_word], minlength=many))
    yield "word-id-sequence", wrong, start[wrong]

    prior = np.r_[-1, np.arange(len(kind) - 1)][: len(kind)]
    follows = (prior >= 0) & (n_of[prior] == n_of) if len(kind) else np.zeros(0, bool)
    after = lambda mask: follows & mask[prior]
    end = np.where(follows & (a[prior] > NONE), a[prior], 0)
    end = np.where(after(ranged), np.where(a[prior] > NONE, a[prior] - 1, NONE), end)
    nth = np.where(after(empty), np.where(b[prior] > NONE, b[prior] + 1, NONE), 1)
    behind = ranged & there(a, end) & (a <= end)
    yield told("misplaced-word-interval", behind)
    yield told("misplaced-empty-node", empty & ((there(a, end) & (a != end)) | (there(b, nth) & (b != nth)) | after(ranged)))
    span = ranged & there(a, end) & ~behind & there(b)
    yield told("reversed-word-interval", span & (b < a))

    # Ranges in order; a missing number may be any.
    r = np.flatnonzero(ranged)
    alone = word & there(a) & (a > count[n_of])
    if alone.any() and len(r):
        asked = np.flatnonzero(alone)
        begins, ends = (np.searchsorted(n_of[r], n_of[asked], side=s) for s in ("left", "right"))
        for i, x, y in zip(asked.tolist(), begins.tolist(), ends.tolist()):
            own = r[x:y]
            alone[i] = not ((a[own] <= a[i]) & ((b[own] >= a[i]) | (b[own] == NONE))).any()
    yield told("word-interval-out", alone | (span & (b >= a) & (b > count[n_of])))
    # The furthest end of the ranges before, within the sentence.
    far = 1 << 32
    ahead = np.maximum.accumulate(n_of[r] * far + np.maximum(b[r], 0)) if len(r) else r
    before = np.r_[-1, ahead[:-1]][: len(r)]
    overlapping = there(a[r]) & (before // far == n_of[r]) & (before % far >= a[r]) & np.r_[False, n_of[r][1:] == n_of[r][:-1]][: len(r)]
    yield told("overlapping-word-intervals", r[overlapping])
