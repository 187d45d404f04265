"""Validation on Arrow columns of the words of many sentences: the gates of a plain sentence, and what a word, its parent and children may be.

Rules are told by the places of the words that break them. Cells of few values are judged once for each different value;
a rule on a relation sees the words of that relation alone. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from arborlake.operators.sentence import EMPTY, RANGE, attributes, universal
from arborlake.sources.cells import Nodes, parted, split

#: Stands for an id that is missing, and for a head that is.
NO_ID, NO_HEAD = -(1 << 60), -(1 << 60) - 1


class Coded:
    """A column of few different values."""

    def __init__(self, column: pa.Array) -> None:
        known = column.dictionary_encode(null_encoding="encode")
        self.values, self.codes = known.dictionary.to_pylist(), np.asarray(known.indices, dtype=np.int64)

    def test(self, fits: Callable[[str], bool], at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Whether the values fit, at these places; a null does not."""
        return np.array([v is not None and bool(fits(v)) for v in self.values], bool)[self.codes[at]]

    def mapped(self, to: Callable[[str | None], int]) -> np.ndarray:
        return np.array([to(v) for v in self.values], np.int64)[self.codes]


class Grouped:
    """Places by the value of a mapped column."""

    def __init__(self, names: dict[str | None, int], codes: np.ndarray) -> None:
        self.names, self.order = names, np.argsort(codes.astype(np.int32), kind="stable")
        self.begins = np.searchsorted(codes[self.order], np.arange(len(names) + 1))

    def __getitem__(self, name: str) -> np.ndarray:
        k = self.names.get(name)
        return np.zeros(0, np.int64) if k is None else self.order[self.begins[k] : self.begins[k + 1]]


def whole(text: str | None, missing: int) -> int:
    """A number in its only spelling, else `missing`."""
    return int(text) if text is not None and len(text) < 10 and text.isascii() and text.isdigit() and str(int(text)) == text else missing


class Words:
    """Words of sentences, in order: `of` (the sentence's number, ascending), id, head; cells by name. Of repeated features the one at `pick` counts."""

    def __init__(self, of: np.ndarray, ids: np.ndarray, heads: np.ndarray, cells: Callable[[str], pa.Array], pick: int = 0) -> None:
        self.of, self.id, self.head, self.pick = of, ids, heads, pick
        self._cells, self._kept, self._below = cells, {}, {}

    def cells(self, name: str) -> pa.Array:
        if name not in self._kept:
            self._kept[name] = self._cells(name)
        return self._kept[name]

    def where(self, keep: np.ndarray) -> Words:
        mask = pa.array(keep)
        return Words(self.of[keep], self.id[keep], self.head[keep], lambda c: self._cells(c).filter(mask), self.pick)

    def _named(self, cell: str | None, name: str) -> str:
        """A feature's or attribute's value, "" where it is missing."""
        found = [v or "" for k, v in attributes(cell or "_") if k == name]
        return found[self.pick] if found else ""

    def place(self, wanted: np.ndarray) -> np.ndarray:
        """The place of the word with this id in each one's own sentence, -1 where there is none: by number first, else the first one."""
        at = self._starts + np.where((wanted > 0) & (wanted <= len(self.of)), wanted, 1) - 1
        inside = np.minimum(at, max(len(self.of) - 1, 0))
        found = np.where((at < len(self.of)) & (self.of[inside] == self.of) & (self.id[inside] == wanted) & (wanted > NO_ID), at, -1)
        lost = np.flatnonzero((found < 0) & (wanted > NO_ID))
        lost = lost[np.isin(wanted[lost], self.id)]
        if len(lost):
            known, rank = np.unique(self.id, return_inverse=True)
            key = self.of * len(known) + rank
            order = np.argsort(key, kind="stable")
            asked = self.of[lost] * len(known) + np.searchsorted(known, wanted[lost])
            first = np.minimum(np.searchsorted(key[order], asked), len(key) - 1)
            found[lost] = np.where(key[order][first] == asked, order[first], -1)
        return found

    @cached_property
    def _starts(self) -> np.ndarray:
        return np.searchsorted(self.of, self.of)

    @cached_property
    def parent(self) -> np.ndarray:
        return self.place(self.head)

    @cached_property
    def _self(self) -> np.ndarray:
        return self.place(self.id)

    @cached_property
    def upos(self) -> Coded:
        return Coded(self.cells("upos"))

    @cached_property
    def feats(self) -> Coded:
        return Coded(self.cells("feats"))

    @cached_property
    def deprel(self) -> Coded:
        return Coded(self.cells("deprel"))

    @cached_property
    def rels(self) -> dict[str | None, int]:
        return {r: i for i, r in enumerate(dict.fromkeys([None, *(v if v is None else universal(v) for v in self.deprel.values)]))}

    @cached_property
    def rel(self) -> np.ndarray:
        return self.deprel.mapped(lambda v: self.rels[v if v is None else universal(v)])

    @cached_property
    def by_rel(self) -> Grouped:
        return Grouped(self.rels, self.rel)

    @cached_property
    def by_parent(self) -> Grouped:
        """Words by their parent's relation."""
        return Grouped(self.rels, np.where(self.parent >= 0, self.rel[self.parent], 0))

    def tag(self, fits: Callable[[str], bool], at: np.ndarray) -> np.ndarray:
        """Whether the tag of the phrase (ExtPos), else the word's, fits."""
        own = np.array([self._named(v, "ExtPos") != "" for v in self.feats.values], bool)[self.feats.codes[at]]
        return np.where(own, self.feats.test(lambda v: fits(self._named(v, "ExtPos")), at), self.upos.test(fits, at))

    def feature(self, fits: Callable[[dict], bool], at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Whether the features, by name, fit; a null has none."""
        of = lambda v: fits({k: self._named(v, k) for k, _ in attributes(v or "_")})
        return np.array([of(v) for v in self.feats.values], bool)[self.feats.codes[at]]

    def children(self, rel: str) -> np.ndarray:
        """How many children of this relation each word has; `subject` are the subjects but outer ones."""
        if rel not in self._below:
            if rel == "subject":
                at = np.concatenate([self.by_rel[r] for r in self.rels if r is not None and "subj" in r] or [np.zeros(0, np.int64)])
                outer = self.deprel.test(lambda v: v in ("nsubj:outer", "csubj:outer"), at)
                at = at[~(outer | Coded(self.cells("misc").take(pa.array(at))).test(lambda v: self._named(v, "Subject") == "Outer"))]
            else:
                at = self.by_rel[rel]
            above = self.parent[at]
            counts = np.bincount(above[above >= 0], minlength=len(self.of))
            self._below[rel] = np.where(self._self >= 0, counts[self._self], 0) if self._repeated else counts
        return self._below[rel]

    @cached_property
    def _repeated(self) -> bool:
        return bool((self._self != np.arange(len(self.of))).any())


Rule = Callable[[Words], np.ndarray]
# Relations whose children make a phrase a clause.
CLAUSE = ("cop", "nsubj", "csubj")


def rules(asked: dict, ruled_out: dict, leaves: dict, nominal: set[str], whole_tags: tuple[str, ...]) -> dict[str, tuple[str, str, Rule]]:
    """test: type, class, and the places of the words that break it; but for what a parent's node or an edge is told of."""
    out: dict[str, tuple[str, str, Rule]] = {}

    def rule(test: str, kind: str = "ERROR", testclass: str = "SYNTAX") -> Callable[[Rule], Rule]:
        return lambda f: out.setdefault(test, (kind, testclass, f))[2]

    def where(mask: np.ndarray) -> np.ndarray:
        return np.flatnonzero(mask)

    rule("pron-det-without-prontype", "WARNING", "MORPHO")(lambda w: where(w.upos.test(lambda v: v in ("PRON", "DET")) & w.feature(lambda f: "PronType" not in f)))
    rule("verbform-fin-without-mood", "WARNING", "MORPHO")(lambda w: where(w.feature(lambda f: f.get("VerbForm") == "Fin" and "Mood" not in f)))
    rule("0-is-not-root")(lambda w: where((w.head == 0) & w.deprel.test(lambda v: universal(v) != "root")))

    @rule("root-is-not-0")
    def _(w: Words) -> np.ndarray:
        at = w.by_rel["root"]
        return at[(w.head[at] != 0) & (w.head[at] > NO_HEAD)]

    rule("fixed-without-extpos", "WARNING")(lambda w: where((w.children("fixed") > 0) & w.feature(lambda f: not f.get("ExtPos"))))

    @rule("upos-rel-punct")
    def _(w: Words) -> np.ndarray:
        at = where(w.deprel.test(lambda v: not universal(v).startswith(("punct", "root"))))
        return at[w.tag(lambda v: v == "PUNCT", at)]

    @rule("rel-upos-fixed")
    def _(w: Words) -> np.ndarray:
        at = where((w.children("fixed") > 0) | w.deprel.test(lambda v: universal(v) == "fixed"))
        return at[w.tag(lambda v: v == "PROPN", at)]

    rule("too-many-subjects")(lambda w: where(w.children("subject") > 1))
    rule("too-many-objects")(lambda w: where(w.children("obj") > 1))

    @rule("obl-should-be-nmod")
    def _(w: Words) -> np.ndarray:
        at = w.by_rel["obl"]
        at = at[w.parent[at] >= 0]
        up = w.parent[at]
        clause = sum(w.children(r)[up] for r in CLAUSE) > 0
        rootless = np.concatenate([w.by_rel[r] for r in CLAUSE])
        clause |= np.isin(w.of[at], w.of[rootless[w.head[rootless] <= NO_HEAD]])  # a clause whose head is missing may be any word's
        return at[w.upos.test(lambda v: v in ("NOUN", "PROPN", "PRON"), up) & w.deprel.test(lambda v: universal(v) in nominal, up) & ~clause]

    rule("goeswith-missing-typo", "ERROR", "MORPHO")(lambda w: where((w.children("goeswith") > 0) & w.feature(lambda f: f.get("Typo") != "Yes")))

    def of_goeswith(test: str, testclass: str, wrong: Callable[[Words, np.ndarray], np.ndarray]) -> None:
        rule(test, "ERROR", testclass)(lambda w: (at := w.by_rel["goeswith"])[wrong(w, at)])

    filled = lambda a: np.asarray(pc.fill_null(a, False), dtype=bool)
    cell = lambda w, name, at: w.cells(name).take(pa.array(at))
    of_goeswith("goeswith-lemma", "MORPHO", lambda w, at: filled(pc.not_equal(cell(w, "lemma", at), "_")))
    of_goeswith("goeswith-upos", "MORPHO", lambda w, at: w.upos.test(lambda v: v != "X", at))
    of_goeswith("goeswith-feats", "MORPHO", lambda w, at: w.feats.test(lambda v: v != "_", at))

    def other_edges(w: Words, at: np.ndarray) -> np.ndarray:
        deps, deprel = cell(w, "deps", at), cell(w, "deprel", at)
        head = pa.array(np.where(w.head[at] > NO_HEAD, w.head[at], 0)).cast(pa.string())
        basic = pc.if_else(pa.array(w.head[at] > NO_HEAD), pc.binary_join_element_wise(head, deprel, ":"), deprel)
        return filled(pc.and_(pc.not_equal(deps, "_"), pc.not_equal(deps, basic)))

    of_goeswith("goeswith-edeps", "ENHANCED", other_edges)

    def of_tag(name: str, fits: Callable[[str], bool]) -> Rule:
        def broken(w: Words) -> np.ndarray:
            at = w.by_rel[name]
            hit = w.tag(lambda v: not fits(v), at)
            return at[hit & (w.children("goeswith")[at] == 0)] if name == "advmod" else at[hit]

        return broken

    for name, tags in asked.items():
        rule(f"rel-upos-{name}")(of_tag(name, (lambda v, t=tags: v in t) if name in whole_tags else (lambda v, t=tags: v.startswith(t))))
    for name, tags in ruled_out.items():
        rule(f"rel-upos-{name}")(of_tag(name, lambda v, t=tags: not v.startswith(t)))
    for name in ("conj", "fixed", "flat", "goeswith", "appos"):
        rule(f"right-to-left-{name}")(lambda w, r=name: (at := w.by_rel[r])[(w.id[at] > NO_ID) & (w.id[at] < w.head[at])])

    def of_leaf(test: str, names: list[str]) -> Rule:
        def broken(w: Words) -> np.ndarray:
            out = []
            for name in names:
                at, allowed = w.by_parent[name], leaves[name][1]
                wrong = w.deprel.test(lambda v, a=allowed: universal(v) not in a, at)
                if name == "det":
                    poss = np.array([w._named(v, "Poss") == "Yes" for v in w.feats.values], bool)[w.feats.codes[w.parent[at]]]
                    wrong &= ~(w.deprel.test(lambda v: universal(v) in ("appos", "acl", "nmod"), at) & poss)
                if name != "punct":
                    wrong &= ~(w.deprel.test(lambda v: universal(v) == "advmod", at) & ~w.upos.test(lambda v: v not in ("PART", "ADV"), at) & w.feature(lambda f: f.get("Polarity") == "Neg", at))
                if name == "goeswith":
                    wrong &= w.deprel.test(lambda v: universal(v) != "punct", at)
                out.append(at[wrong])
            return np.concatenate(out)

        return broken

    for test in dict.fromkeys(t for t, _ in leaves.values()):
        rule(test)(of_leaf(test, [n for n, (t, _) in leaves.items() if t == test]))
    return out


def edges(deps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the cells with edges from 0 that are no `root`, and of those with a `root` from elsewhere; one for each edge."""
    likely = pc.or_(pc.or_(pc.starts_with(deps, "0"), pc.match_substring(deps, "|0")), pc.match_substring(deps, "root"))
    at = np.flatnonzero(np.asarray(pc.fill_null(pc.and_(likely, pc.not_equal(deps, "_")), False), dtype=bool))
    if not len(at):
        return at, at
    of, listed = split(deps.take(pa.array(at)), "|")
    head, label = parted(listed)
    top = np.asarray(pc.equal(head, "0"))
    root = np.asarray(pc.or_(pc.equal(label, "root"), pc.starts_with(label, "root:")))
    return at[of[top & ~root]], at[of[~top & root]]


def orphans(w: Words, parents: set[str]) -> np.ndarray:
    """Orphans below another relation than those of `parents`."""
    at = w.by_rel["orphan"]
    up = w.parent[at]
    return at[~((up >= 0) & w.deprel.test(lambda v: universal(v) in parents, up))]


def foreign(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words of flat:foreign that are not tagged so, and those whose parent is not."""
    at = np.flatnonzero(w.deprel.test(lambda v: v == "flat:foreign"))
    other = lambda x: w.upos.test(lambda v: v != "X", x) | w.feats.test(lambda v: v != "Foreign=Yes", x)
    up = w.parent[at]
    fits = w.upos.test(lambda v: v == "X", up) & w.feats.test(lambda v: v == "Foreign=Yes", up)
    return at[other(at)], at[~((up >= 0) & fits)]


class Gates:
    """What stops the checks of each sentence of a batch of texts.

    `odd` are sentences that are left to the walk: levels 1 and the references of level 2 may find something there. Of the
    others, `looped` holds the first word that is its own head (-1: none), `sound` says whether the tree and features are.
    """

    def __init__(self, raw: pa.Array, ended: bool, feature: Callable[[str], bool]) -> None:
        self.nodes = nodes = Nodes(raw)
        many = nodes.sentences
        odd = np.zeros(many, bool)
        at = np.arange(len(nodes.lines))
        starts = np.searchsorted(nodes.all_of, np.arange(many))
        self.node_at = at[nodes.node]
        comments = np.bincount(nodes.all_of[nodes.comment], minlength=many)
        self.first = comments + 1
        odd[nodes.foreign] = True
        rest = ~nodes.comment & ~nodes.node
        if not ended:  # the text brings its own blank last line, and no other one
            ends = np.searchsorted(nodes.all_of, np.arange(many), side="right") - 1
            blank = np.asarray(pc.equal(nodes.lines, ""))
            there = ends >= starts
            odd |= ~there
            odd[there] |= ~blank[ends[there]]
            rest[ends[there]] = rest[ends[there]] & ~blank[ends[there]]
        odd[nodes.all_of[rest]] = True
        odd[nodes.all_of[nodes.comment & (at - starts[nodes.all_of] >= comments[nodes.all_of])]] = True
        odd[nodes.of[nodes.many != 10]] = True
        self.line = self.node_at - starts[nodes.of] + 1

        ranged, word = nodes.ranged, nodes.word
        self.words = np.flatnonzero(word)
        of = nodes.of[self.words]
        self.counts = np.bincount(of, minlength=many)
        odd |= self.counts == 0
        self.begin = np.cumsum(self.counts) - self.counts
        self.number = np.arange(len(of)) - self.begin[of] + 1
        texts = pa.array(map(str, range(int(self.counts.max(initial=0)) + 1)), pa.string())
        odd[of[np.asarray(pc.not_equal(nodes["id"].filter(pa.array(word)), texts.take(pa.array(self.number))))]] = True
        self._lines(odd, word)

        heads = Coded(nodes["head"].filter(pa.array(word)))
        self.head = heads.mapped(lambda v: whole(v, -1))
        odd[of[(self.head < 0) | (self.head > self.counts[of])]] = True
        self._references(odd, ranged)
        self.odd = odd

        loops = np.flatnonzero((self.head == self.number) & ~odd[of])
        self.looped = np.full(many, -1)
        self.looped[of[loops[::-1]]] = loops[::-1]
        # Pointers are doubled; `last` is the root.
        last = len(of)
        up = np.append(np.where((self.head > 0) & ~odd[of], self.begin[of] + self.head - 1, last), last)
        for _ in range(int(self.counts.max(initial=0)).bit_length() + 1):
            up = up[up]
            if (up == last).all():
                break
        lost = np.bincount(of[up[:-1] != last], minlength=many) > 0
        roots = np.bincount(of[self.head == 0], minlength=many)
        known = Coded(nodes["feats"])
        broken = np.bincount(nodes.of[known.test(lambda v: not feature(v))], minlength=many) > 0
        self.sound = ~odd & (self.looped < 0) & (roots <= 1) & ~lost & ~broken

    def _lines(self, odd: np.ndarray, word: np.ndarray) -> None:
        """Ranges and empty nodes: plain where a range begins with the next word, behind all ranges, and an empty node follows its word or the one before it."""
        nodes, cells = self.nodes, self.nodes["id"]
        at = np.flatnonzero(~word)
        prior = np.maximum(at - 1, 0)
        of = nodes.of[at]
        follows = ((at > 0) & (nodes.of[prior] == of)).tolist()
        ahead = (np.cumsum(word)[at] - self.begin[of]).tolist()
        texts, before = (cells.take(pa.array(x)).to_pylist() for x in (at, prior))
        end, ended = -1, 0
        for of, follow, ahead, many, cell, above in zip(of.tolist(), follows, ahead, self.counts[of].tolist(), texts, before):
            if m := RANGE.fullmatch(cell):
                a, b = int(m[1]), int(m[2])
                ended = ended if end == of else 0
                odd[of] |= not (a == ahead + 1 and a <= b <= many and a > ended)
                end, ended = of, max(ended, b)
            elif m := EMPTY.fullmatch(cell):
                a, b = int(m[1]), int(m[2])
                odd[of] |= not (follow and a == ahead and a > 0 and m[1] == str(a) and above == (m[1] if b == 1 else f"{a}.{b - 1}"))
            else:
                odd[of] = True

    def _references(self, odd: np.ndarray, ranged: np.ndarray) -> None:
        """Sentences with edges from what is no node."""
        nodes = self.nodes
        deps = nodes["deps"]
        at = np.flatnonzero(np.asarray(pc.not_equal(deps, "_")) & ~ranged)
        of, listed = split(deps.take(pa.array(at)), "|")
        of = nodes.of[at[of]]
        pieces = pc.split_pattern(listed, ":", max_splits=1)
        many = np.asarray(pc.list_value_length(pieces), dtype=np.int64)
        odd[of[many != 2]] = True
        heads = Coded(pieces.flatten().take(pa.array(np.cumsum(many) - many)))
        number = heads.mapped(lambda v: whole(v, -1))
        wrong = (number < 0) | (number > self.counts[of])
        if wrong.any():
            empty = nodes.empty
            known = set(zip(nodes.of[empty].tolist(), nodes["id"].filter(pa.array(empty)).to_pylist()))
            for i in np.flatnonzero(wrong).tolist():
                if (int(of[i]), heads.values[heads.codes[i]]) not in known:
                    odd[of[i]] = True

    def level3(self, pick: int) -> tuple[Words, np.ndarray]:
        """The words of sound sentences, and their node lines."""
        keep = self.sound[self.nodes.of[self.words]]
        at = self.words[keep]
        place = pa.array(at)
        return Words(self.nodes.of[at], self.number[keep], self.head[keep], lambda c: self.nodes[c].take(place), pick), at


def batches(column: pa.Array, many: int) -> Iterator[tuple[int, int]]:
    """Cuts of a batch of texts, of some `many` bytes each."""
    share = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)) // many
    cuts = [0, *(np.flatnonzero(np.diff(share)) + 1), len(column)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b)
