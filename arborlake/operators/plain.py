"""What the chain of checks finds in the sentences of a batch, levels 1 to 3, and their facts, on Arrow columns.

Columns decide what is common, and tell which node or sentence may have something rare: only there the rule of
`checks` itself is asked. Sentences that an early check may stop, or in which level 1 may find something, are left to
the walk, whole. Nothing is shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from arborlake.operators import checks
from arborlake.operators.columns import Coded, Gates, Words, foreign, orphans
from arborlake.operators.sentence import RANGE, Node, Tree, id_of, universal
from arborlake.sources.cells import lists, parted, split
from arborlake.sources.conllu import COLUMNS
from arborlake.sources.registry import RELATIONS, UPOS

#: Numbers of sentences, then level, type, class, test, lines, nodes, messages: an array each, or one value for all.
Told = tuple

# White space but the tab (Python's), comments that may be metadata, and their usual spelling.
_SPACE = r"[\x0b-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_METADATA = r"^#[^a-zA-Z]*(sent_id|parallel_id|text[^a-zA-Z_]*=|newdoc|newpar)"
_USUAL = {
    "sent_id": (r"^# sent_id = [!-.0-~]+$", 12),
    "parallel_id": (r"^# parallel_id = [a-z]+/[-0-9a-z]+(/(alt[1-9][0-9]*|part[1-9][0-9]*|alt[1-9][0-9]*part[1-9][0-9]*))?$", 16),
    "newdoc": (r"^# newdoc( id = [!-~]+)?$", 0), "newpar": (r"^# newpar( id = [!-~]+)?$", 0),
    "text": (r"^# text = [^\x00-\x20\x7f-\x{a0}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}]", 9),
}
_PATTERNS = {"sent_id": checks.SENT_ID, "parallel_id": checks.PARALLEL_ID, "text": checks.TEXT, **checks.NEW}
#: Tests of features, of the other cells, of comments and text.
FEATURES = {"unsorted-features", "invalid-feature", "repeated-feature-value", "unsorted-feature-values", "invalid-feature-value", "repeated-feature"}
CELLS = {
    "mwt-nonempty-field", "empty-node-nonempty-field", "unknown-upos", "empty-string-in-xpos", "invalid-deprel", "unknown-udeprel", "unsorted-deps", "unsorted-deps-2", "repeated-deps", "deps-self-loop", "invalid-edeprel",
    "unknown-eudeprel", "empty-misc-key", "empty-misc", "misc-extra-space", "misc-attr-typo", "repeated-misc",
}
METADATA = {
    "invalid-sent-id", "invalid-parallel-id", "missing-sent-id", "multiple-sent-id", "slash-in-sent-id", "multiple-parallel-id", "multiple-newdoc", "multiple-newpar", "missing-text", "multiple-text", "empty-text",
    "text-trailing-whitespace", "nospaceafter-yes", "spaceafter-value", "spaceafter-empty-node", "spaceafter-mwt-node", "text-form-mismatch", "missing-spaceafter", "text-extra-chars",
}
#: What level 1 finds without stopping the chain.
LOOSE = {"unicode-normalization", "invalid-whitespace-mwt", "invalid-whitespace", "empty-column", "leading-whitespace", "trailing-whitespace", "repeated-whitespace"}
#: Pairs of words that are compared at a time.
PAIRS = 1 << 22


def arrays(told: list[Told], rows: list[tuple], types: list[pa.DataType]) -> tuple[pa.Array, list[pa.Array]]:
    """Numbers of sentences, and columns of these types, of what is told in columns and of rows."""
    of = pa.array(np.concatenate([*(np.asarray(t[0], np.int64) for t in told), np.array([r[0] for r in rows], np.int64)]))
    made = []
    for i, kind in enumerate(types, 1):
        parts = []
        for t in told:
            if isinstance(t[i], pa.Array):
                parts.append(t[i].cast(kind))
            elif isinstance(t[i], np.ndarray):
                parts.append(pa.array(t[i], kind))
            elif len(t[0]):  # lists do not repeat 0 times
                parts.append(pa.repeat(pa.scalar(t[i], kind), len(t[0])))
        made.append(pa.concat_arrays([*parts, pa.array([r[i] for r in rows], kind)]))
    return of, made


def filtered(told: list[Told], kept: Callable[[str, str], bool]) -> list[Told]:
    """What is told of the tests that are kept; types are given for all rows."""
    out = []
    for t in told:
        if isinstance(t[4], str):
            out += [t] if kept(t[2], t[4]) else []
        else:
            keep = Coded(t[4]).test(lambda v, kind=t[2]: kept(kind, v))
            out.append(tuple(x[keep] if isinstance(x, np.ndarray) else x.filter(pa.array(keep)) if isinstance(x, pa.Array) else x for x in t))
    return out


def ranges(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which range, place) of all places in ranges, of some PAIRS places at a time; end is exclusive."""
    counts = np.maximum(end - begin, 0)
    sums = np.cumsum(counts)
    cuts = [0, *(np.flatnonzero(np.diff(sums // PAIRS)) + 1), len(counts)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            many = counts[a:b]
            which = np.repeat(np.arange(a, b), many)
            yield which, np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + begin[which]


def nests(up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a forest (the parent's place, -1 at the top): each one's place in preorder, and how many it dominates, itself counted."""
    order = np.argsort(up, kind="stable")
    begins, ends = (np.searchsorted(up[order], np.arange(-1, len(up)), side=s) for s in ("left", "right"))
    levels = [order[begins[0] : ends[0]]]
    while len(levels[-1]):
        at = levels[-1] + 1
        levels.append(order[np.concatenate([p for _, p in ranges(begins[at], ends[at])] or [np.zeros(0, np.int64)])])
    size, first = np.ones(len(up), np.int64), np.zeros(len(up), np.int64)
    for below in reversed(levels[1:]):
        np.add.at(size, up[below], size[below])
    for k, at in enumerate(levels):
        before = np.cumsum(size[at]) - size[at]
        if k and len(at):
            new = np.r_[True, up[at][1:] != up[at][:-1]]
            before += first[up[at]] + 1 - before[new][np.cumsum(new) - 1]
        first[at] = before
    return first, size


class Crossings:
    """Gaps and crossing edges of words of sound trees (see `checks.gap` and `checks.crossed_by`)."""

    def __init__(self, w: Words) -> None:
        self.w = w
        self.first, self.size = nests(w.parent)

    def _above(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a dominates b, or is it."""
        return (self.first[a] <= self.first[b]) & (self.first[b] < self.first[a] + self.size[a])

    def gap(self, at: np.ndarray) -> np.ndarray:
        up = self.w.parent[at]
        out = np.zeros(len(at), bool)
        low, high = np.minimum(at, up), np.maximum(at, up)
        for which, place in ranges(np.where(up >= 0, low + 1, 0), np.where(up >= 0, high, 0)):
            out[which[~self._above(up[which], place)]] = True
        return out

    def crossed(self, at: np.ndarray) -> np.ndarray:
        w, out = self.w, np.zeros(len(at), bool)
        begins, ends = (np.searchsorted(w.of, w.of[at], side=s) for s in ("left", "right"))
        for which, place in ranges(begins, ends):
            over = w.parent[place]
            low, high = np.minimum(place, over), np.maximum(place, over)
            n, up = at[which], w.parent[at[which]]
            hit = np.flatnonzero((over >= 0) & (low < n) & (n < high) & ~((low <= up) & (up <= high)))
            out[which[hit[~self._above(over[hit], n[hit])]]] = True
        return out


def _misses(generator: Callable[..., Iterator], *args) -> bool:
    return any(True for _ in generator(*args))


def _odd_line(line: str) -> bool:
    return _misses(checks.columns, checks.Sentence("", "", {}, lines=[line]))


class Plain(Gates):
    """Findings and facts of a batch of texts. `walked` are sentences whose findings are left to the walk; what is asked for are tests by name, or all."""

    def __init__(self, raw: pa.Array, ended: bool, asked: set[str] | None = None) -> None:
        super().__init__(raw, ended, checks._well_formed)
        self.raw, self.asked = raw, asked
        self.node_of = self.nodes.of
        self.passed = self.sound.copy()
        self.walked = self.odd | (~self.sound & (self.looped < 0))
        if asked is None or asked & LOOSE:
            self._loose()
        self.sound &= ~self.walked

    def wants(self, *tests: str) -> bool:
        return self.asked is None or not self.asked.isdisjoint(tests)

    def texts(self, which: np.ndarray, whole: bool) -> list[tuple[int, str]]:
        """The numbers and texts of sentences, with the line that ends them."""
        at = np.flatnonzero(which)
        return [(i, raw + "\n" if whole else raw) for i, raw in zip(at.tolist(), self.raw.take(pa.array(at)).to_pylist())]

    def _loose(self) -> None:
        foreign = np.flatnonzero(~np.asarray(pc.string_is_ascii(self.raw)))
        texts = self.raw.take(pa.array(foreign)).to_pylist()
        self.walked[[i for i, t in zip(foreign.tolist(), texts) if not unicodedata.is_normalized("NFC", t)]] = True
        line = self.nodes.line
        likely = pc.or_(pc.match_substring_regex(line, _SPACE), pc.or_(pc.match_substring(line, "\t\t"), pc.or_(pc.starts_with(line, "\t"), pc.ends_with(line, "\t"))))
        at = np.flatnonzero(np.asarray(likely) & ~self.walked[self.node_of])
        self.walked[self.node_of[[i for i, t in zip(at.tolist(), line.take(pa.array(at)).to_pylist()) if _odd_line(t)]]] = True

    def _node(self, at: int) -> Node:
        return Node(self.nodes.line[at].as_py().split("\t"), int(self.line[at]))

    def _sentence(self, of: int) -> checks.Sentence:
        raw = self.raw[of].as_py()
        lines = raw.split("\n")
        return checks.Sentence(raw, "", {}, "ud", lines, [x for x in lines if x.startswith("#")], int(self.first[of]), Tree(raw))

    @cached_property
    def _edges(self) -> tuple[np.ndarray, Coded, Coded]:
        """Of all edges of words and empty nodes: the node's place, head, label."""
        deps = self.nodes["deps"]
        at = np.flatnonzero(np.asarray(pc.not_equal(deps, "_")) & ~self.nodes.ranged & self.passed[self.node_of])
        of, listed = split(deps.take(pa.array(at)), "|")
        head, label = parted(listed)
        return at[of], Coded(head), Coded(label)

    @cached_property
    def _comments(self) -> tuple[np.ndarray, pa.Array, dict[str, np.ndarray], np.ndarray]:
        """Comments that may be metadata: sentence, text, which are of a kind in usual spelling, which are in another one."""
        comment = self.nodes.lines.filter(pa.array(self.nodes.comment))
        at = np.flatnonzero(np.asarray(pc.match_substring_regex(comment, _METADATA)))
        texts = comment.take(pa.array(at))
        kinds = {k: np.asarray(pc.match_substring_regex(texts, p)) for k, (p, _) in _USUAL.items()}
        return self.nodes.all_of[self.nodes.comment][at], texts, kinds, ~np.logical_or.reduce([*kinds.values()])

    def found(self, level: int) -> tuple[list[Told], list[tuple]]:
        """Findings of all sentences but the walked ones; in columns, and one by one (the sentence's number before each)."""
        self.rows: list[tuple] = []
        return list(self._found(level)), self.rows

    def _found(self, level: int) -> Iterator[Told]:
        none = lambda at: pa.repeat("", len(at))
        if self.wants("head-self-loop"):
            of = np.flatnonzero((self.looped >= 0) & ~self.walked)
            at = self.words[self.looped[of]]
            yield of, 2, "ERROR", "SYNTAX", "head-self-loop", self.line[at], self.nodes["id"].take(pa.array(at)), none(at)
        sound = np.flatnonzero(self.sound)
        yield sound, 0, "FACT", "", "", self.first[sound], none(sound), none(sound)
        if self.wants(*FEATURES):
            yield from self._features()
        if self.wants(*CELLS):
            self._cells()
        if self.wants(*METADATA):
            missing = self._textless() if self.asked is not None and self.asked & METADATA == {"missing-text"} else self._metadata()
            yield missing, 2, "ERROR", "METADATA", "missing-text", self.first[missing], none(missing), none(missing)
        if self.wants("unconnected-egraph"):
            for i in np.flatnonzero(self._unconnected()).tolist():
                self.rows += [(i, *f) for f in checks.graph_connected(self._sentence(i))]
        if level >= 3:
            yield from self._content()

    def _features(self) -> Iterator[Told]:
        """A cell's findings are those of its text: each different one is judged once."""
        known = Coded(self.nodes["feats"])
        cell = lambda v: Node([*"1____", v, *"____"], 0)
        judged = [list(checks.feature_cell(cell(v))) if v != "_" else [] for v in known.values]
        many = np.array([len(x) for x in judged], np.int64)
        at = np.flatnonzero((many[known.codes] > 0) & self.sound[self.node_of])
        code = known.codes[at]
        starts = np.cumsum(many) - many
        which, place = (np.concatenate(x) for x in zip(*ranges(starts[code], starts[code] + many[code]))) if len(at) else (at, at)
        flat, at = [f for x in judged for f in x], at[which]
        told = lambda name: pa.array([getattr(f, name) for f in flat], pa.string()).take(pa.array(place))
        yield self.node_of[at], 2, "ERROR", "MORPHO", told("testid"), self.line[at], self.nodes["id"].take(pa.array(at)), told("message")

    def _cells(self) -> None:
        nodes = self.nodes
        ranged, empty, word = nodes.ranged, nodes.empty, nodes.word
        other = lambda columns: np.logical_or.reduce([np.asarray(pc.not_equal(nodes[c], "_")) for c in columns])
        likely = (ranged & other(COLUMNS[2:9])) | (empty & other(COLUMNS[6:8]))
        likely |= ~ranged & Coded(nodes["upos"]).test(lambda v: v not in UPOS)
        likely |= word & Coded(nodes["deprel"]).test(lambda v: not checks.DEPREL.fullmatch(v) or universal(v) not in RELATIONS)
        likely |= Coded(nodes["misc"]).test(lambda v: v != "_" and _misses(checks.misc_cell, Node([*"1________", v], 0)))
        at, head, label = self._edges
        likely[at[label.test(lambda d: not checks.ENHANCED_DEPREL.fullmatch(d) or (universal(d) not in RELATIONS and universal(d) != "ref"))]] = True
        key = head.mapped(lambda h: (lambda i: (i[0] << 31) + i[1])(id_of(h)))
        likely[at[1:][(at[1:] == at[:-1]) & (key[1:] <= key[:-1])]] = True
        ids = nodes["id"].take(pa.array(at))
        likely[at[np.asarray(pc.equal(ids, pa.array(head.values, pa.string()).take(pa.array(head.codes))))]] = True
        for i in np.flatnonzero(likely & self.sound[self.node_of]).tolist():
            s = checks.Sentence("", "", {}, tree=Tree(""))
            s.tree.nodes.append(self._node(i))
            self.rows += [(int(self.node_of[i]), *f) for f in checks.cells(s) if f.testid not in FEATURES]

    def _textless(self) -> np.ndarray:
        """The sentences without a text."""
        comment, of = self.nodes.lines.filter(pa.array(self.nodes.comment)), self.nodes.all_of[self.nodes.comment]
        likely = np.flatnonzero(np.asarray(pc.match_substring(comment, "text")))
        named = [i for i, c in zip(likely.tolist(), comment.take(pa.array(likely)).to_pylist()) if checks.TEXT.fullmatch(c)]
        return np.flatnonzero(self.sound & (np.bincount(of[named], minlength=self.nodes.sentences) == 0))

    def _metadata(self) -> np.ndarray:
        """The sentences without a text and other faults; the others are judged one by one."""
        of, texts, kinds, unusual = self._comments
        count = {k: np.bincount(of[hit], minlength=self.nodes.sentences) for k, hit in kinds.items()}
        likely = (count["sent_id"] != 1) | np.logical_or.reduce([count[k] > 1 for k in ("parallel_id", "newdoc", "newpar", "text")])
        likely[of[unusual]] = True
        texted = self.sound & ~likely & (count["text"] == 1)
        if texted.any():
            likely |= texted & self._unlike(of[kinds["text"]], pc.utf8_slice_codeunits(texts.filter(pa.array(kinds["text"])), _USUAL["text"][1]))
        for i in np.flatnonzero(likely & self.sound).tolist():
            self.rows += [(i, *f) for f in checks.metadata(self._sentence(i))]
        return np.flatnonzero(self.sound & ~likely & (count["text"] == 0))

    def _covered(self) -> np.ndarray:
        """Which nodes are words of a range."""
        nodes, out = self.nodes, np.zeros(len(self.words) + 1, np.int64)
        at = np.flatnonzero(nodes.ranged & self.passed[nodes.of])
        for of, text in zip(nodes.of[at].tolist(), nodes["id"].take(pa.array(at)).to_pylist()):
            m = RANGE.fullmatch(text)
            out[self.begin[of] + int(m[1]) - 1] += 1
            out[self.begin[of] + int(m[2])] -= 1
        covered = np.zeros(len(nodes.of), bool)
        covered[self.words] = np.cumsum(out)[:-1] > 0
        return covered

    def _unlike(self, of: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Sentences whose text (one each, at most) is not that of their forms with usual spaces. Level 1 finds nothing in them."""
        nodes, many = self.nodes, self.nodes.sentences
        misc = Coded(nodes["misc"])
        glued = misc.test(lambda v: "SpaceAfter=No" in v.split("|"))
        odd = misc.test(lambda v: "SpaceAfter" in v and ("NoSpaceAfter=Yes" in v or ("SpaceAfter=No" in v) != ("SpaceAfter=No" in v.split("|")) or any(p.startswith("SpaceAfter=") and p != "SpaceAfter=No" for p in v.split("|"))))
        inner = nodes.empty | self._covered()
        unlike = np.bincount(nodes.of[odd | (inner & glued)], minlength=many) > 0
        at = np.flatnonzero(~inner & (np.bincount(of, minlength=many) > 0)[nodes.of])
        last = np.r_[nodes.of[at][1:] != nodes.of[at][:-1], True][: len(at)]
        gap = pa.array(["", " "]).take(pa.array((~glued[at] & ~last).astype(np.int64)))
        token = pc.binary_join_element_wise(nodes["form"].take(pa.array(at)), gap, "")
        joined = pc.binary_join(lists(np.concatenate([[0], np.cumsum(np.bincount(nodes.of[at], minlength=many))]), token), "")
        unlike[of[np.asarray(pc.not_equal(joined.take(pa.array(of)), texts))]] = True
        return unlike

    def _unconnected(self) -> np.ndarray:
        """Sentences with nodes of the enhanced graph that its root does not reach: all graphs are searched at once, each edge is passed once."""
        at, head, _ = self._edges
        number = head.mapped(lambda h: int(h) if h.isdigit() else -1)
        of = self.node_of[at]
        source = np.full(len(at), -1)
        source[number > 0] = self.words[self.begin[of[number > 0]] + number[number > 0] - 1]
        lost = np.flatnonzero(number < 0)
        if len(lost):
            empty = np.flatnonzero(self.nodes.empty)
            known = dict(zip(zip(self.node_of[empty].tolist(), self.nodes["id"].take(pa.array(empty)).to_pylist()), empty.tolist()))
            source[lost] = [known.get((int(of[i]), head.values[head.codes[i]]), -2) for i in lost]
        order = np.argsort(source, kind="stable")
        target, places = at[order], np.arange(-1, len(self.node_of))
        begins, ends = (np.searchsorted(source[order], places, side=s) for s in ("left", "right"))
        reached = np.zeros(len(self.node_of), bool)
        front = np.unique(target[begins[0] : ends[0]])
        while len(front):
            reached[front] = True
            following = np.concatenate([target[p] for _, p in ranges(begins[front + 1], ends[front + 1])] or [front[:0]])
            front = np.unique(following[~reached[following]])
        return (np.bincount(of[~reached[at]], minlength=self.nodes.sentences) > 0) & self.sound

    def _content(self) -> Iterator[Told]:
        nodes = self.nodes
        words, lines = self.level3(-1)

        def told(kind: str, testclass: str, test: str, at: np.ndarray) -> Told:
            at = lines[at]
            cell = lambda c: nodes[c].take(pa.array(at))
            return nodes.of[at], 3, kind, testclass, test, self.line[at], cell("id"), pc.binary_join_element_wise(cell("form"), cell("upos"), cell("deprel"), " ")

        for test, (kind, testclass, broken) in checks.CONTENT.items():
            if self.wants(test):
                yield told(kind, testclass, test, broken(words))
        if self.wants("orphan-parent"):
            at = orphans(words, checks.ORPHAN_PARENTS)
            yield told("WARNING", "SYNTAX", "orphan-parent", np.where(words.parent[at] >= 0, words.parent[at], at))
        if self.wants("flat-foreign-upos-feats"):
            own, below = foreign(words)
            up = words.parent[below]
            yield told("WARNING", "MORPHO", "flat-foreign-upos-feats", np.concatenate([own, up[up >= 0]]))
            top = words.of[below[up < 0]]
            yield top, 3, "WARNING", "MORPHO", "flat-foreign-upos-feats", np.zeros(len(top), np.int64), pa.repeat("0", len(top)), pa.repeat("  ", len(top))
        if self.wants("enhanced-0-is-not-root", "enhanced-root-is-not-0"):
            at, head, label = self._edges
            zero, root = head.test(lambda h: h == "0"), label.test(lambda d: universal(d) == "root")
            for test, hit in (("enhanced-0-is-not-root", zero & ~root), ("enhanced-root-is-not-0", ~zero & root)):
                k = np.flatnonzero(hit & self.sound[self.node_of[at]])
                node = at[k]
                yield self.node_of[node], 3, "ERROR", "ENHANCED", test, self.line[node], nodes["id"].take(pa.array(node)), pa.array(label.values, pa.string()).take(pa.array(label.codes[k]))
        if self.wants("fixed-gap", "goeswith-gap", "goeswith-nospace"):
            yield told("WARNING", "SYNTAX", "fixed-gap", self._fixed(words))
            apart, unspaced = self._goeswith(words)
            yield told("ERROR", "SYNTAX", "goeswith-gap", apart)
            yield told("ERROR", "SYNTAX", "goeswith-nospace", unspaced)
        if self.wants("punct-causes-nonproj", "punct-is-nonproj", "leaf-goeswith"):
            crossings, punct = Crossings(words), words.by_rel["punct"]
            yield told("ERROR", "SYNTAX", "punct-causes-nonproj", punct[crossings.crossed(punct)])
            yield told("ERROR", "SYNTAX", "punct-is-nonproj", punct[crossings.gap(punct)])
            at = words.by_parent["goeswith"]
            at = at[words.deprel.test(lambda v: universal(v) == "punct", at)]
            yield told("ERROR", "SYNTAX", "leaf-goeswith", at[~crossings.gap(words.parent[at])])

    def _fixed(self, w: Words) -> np.ndarray:
        """Words between which and their last fixed child there is something else than punctuation and fixed children."""
        at = w.by_rel["fixed"]
        at = at[w.parent[at] >= 0]
        last = np.full(len(w.of), -1)
        np.maximum.at(last, w.parent[at], at)
        behind = np.bincount(w.parent[at[at > w.parent[at]]], minlength=len(w.of))
        other = np.cumsum(np.r_[0, ~w.deprel.test(lambda v: universal(v) == "punct")])
        n = np.flatnonzero(last > np.arange(len(w.of)))
        return n[other[last[n] + 1] - other[n + 1] > behind[n]]

    def _goeswith(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words that do not stand together with their goeswith children, and those where one but the last has no space after it."""
        at = w.by_rel["goeswith"]
        at = at[w.parent[at] >= 0]
        up = w.parent[at]
        many = np.bincount(up, minlength=len(w.of))
        n = np.flatnonzero(many)
        first, last = np.arange(len(w.of)), np.arange(len(w.of))
        np.minimum.at(first, up, at)
        np.maximum.at(last, up, at)
        apart = n[(first[n] < n) | (last[n] - n != many[n])]
        member, of = np.concatenate([n, at]), np.concatenate([n, up])
        unspaced = Coded(w.cells("misc").take(pa.array(member))).test(lambda v: w._named(v, "SpaceAfter") == "No") & (member != last[of])
        return apart, np.unique(of[unspaced])

    def facts(self, which: np.ndarray | None = None) -> tuple[np.ndarray, list[pa.Array]]:
        """The sentences that pass levels 1 and 2 (but odd ones; or `which` of them), and their facts (checks.FACTS)."""
        nodes, many = self.nodes, self.nodes.sentences
        which = self.passed if which is None else which
        passed = np.flatnonzero(which)
        of, texts, kinds, unusual = self._comments
        others = [(int(of[i]), c, k, m) for i in np.flatnonzero(unusual).tolist() for c in (texts[i].as_py(),) for k, p in _PATTERNS.items() if (m := p.fullmatch(c))]

        def named(kind: str) -> pa.Array:
            at = np.flatnonzero(kinds[kind])
            values = pc.utf8_slice_codeunits(texts.take(pa.array(at)), _USUAL[kind][1])
            more = [(i, c, m[1]) for i, c, k, m in others if k == kind]
            where = np.concatenate([of[at], np.array([i for i, *_ in more], np.int64)])
            first = np.full(many, -1)
            first[where[::-1]] = np.arange(len(where))[::-1]
            both = {i for i, *_ in more} & set(of[at].tolist())
            got = pc.fill_null(pa.concat_arrays([values, pa.array([v for *_, v in more], pa.string())]).take(pa.array(first, mask=first < 0)), "").take(pa.array(passed))
            if both:  # in both spellings: the first comment counts
                got = pa.array([next(m[1] for c in self.raw[i].as_py().split("\n") if c.startswith("#") and (m := _PATTERNS[kind].fullmatch(c))) if i in both else v for i, v in zip(passed.tolist(), got.to_pylist())], pa.string())
            return got

        begins = np.bincount(of[kinds["newdoc"] | kinds["newpar"]], minlength=many) > 0
        begins[[i for i, _, k, _ in others if k in checks.NEW]] = True
        glued = Coded(nodes["misc"]).test(lambda v: "SpaceAfter=No" in v.split("|"))
        ends = np.zeros(many, bool)
        last = self.words[np.maximum(self.begin + self.counts - 1, 0)[passed]] if len(passed) else passed
        ends[passed] = glued[last]
        at = np.flatnonzero(nodes.ranged & self.passed[nodes.of])
        for i, s, text in zip(at.tolist(), nodes.of[at].tolist(), nodes["id"].take(pa.array(at)).to_pylist()):
            if int(RANGE.fullmatch(text)[2]) == self.counts[s]:
                ends[s] = glued[i]
        deps = nodes["deps"]
        at = np.flatnonzero(np.asarray(pc.not_equal(deps, "_")) & ~nodes.ranged & which[nodes.of])
        place = pa.array(at)
        basic = pc.binary_join_element_wise(nodes["head"].take(place), nodes["deprel"].take(place), ":")
        count = lambda hit: np.bincount(nodes.of[hit], minlength=many)
        edge_at, _, label = self._edges
        orphan = np.unique(edge_at[label.test(lambda d: universal(d) == "orphan")])
        orphan = orphan[which[nodes.of[orphan]]]

        def listed(hit: np.ndarray) -> pa.Array:
            return lists(np.concatenate([[0], np.cumsum(count(hit)[passed])]), nodes["id"].take(pa.array(hit)))

        flag = lambda mask: pa.array(mask[passed])
        differs = count(at[np.asarray(pc.not_equal(deps.take(place), basic))]) > 0
        return passed, [named("sent_id"), named("parallel_id"), flag(begins), flag(ends), flag(count(at) > 0), flag(differs), listed(at[nodes.empty[at]]), listed(orphan)]
