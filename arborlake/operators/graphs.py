"""Enhanced graphs and trees: components, cycles, edge types, collapsing of empty nodes, repairs.

A graph is one sentence's, so each operator is a step over sentences: searches run on its edges in memory
and nothing is shuffled; counts over a treebank are sums of the sentences' counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.operators.plain import ranges
from arborlake.operators.sentence import Id, Tree, id_of, id_text, per_sentence, universal
from arborlake.sources import cells

Edge = tuple[Id, Id, str]


class Graph:
    """The enhanced edges of a sentence, by both ends; an edge given twice is kept once."""

    def __init__(self, raw: str) -> None:
        self.tree = Tree(raw)
        self.nodes = [n.id for n in self.tree.enhanced]
        self.into: dict[Id, list[tuple[Id, str]]] = {i: [] for i in [(0, 0), *self.nodes]}
        self.out: dict[Id, list[tuple[Id, str]]] = {i: [] for i in [(0, 0), *self.nodes]}
        for n in self.tree.enhanced:
            for h, d in dict.fromkeys(n.edges):
                self.into[n.id].append((h, d))
                self.out.setdefault(h, []).append((n.id, d))
                self.into.setdefault(h, [])
        self.basic = {n.id: (id_of(n.head), n.deprel) for n in self.tree.enhanced if n.kind == "word" and n.head.isdigit()}

    def path(self, a: Id, b: Id) -> bool:
        seen, stack = set(), [a]
        while stack:
            x = stack.pop()
            if x == b:
                return True
            if x not in seen:
                seen.add(x)
                stack += (y for y, _ in self.out[x])
        return False

    def cyclic(self) -> bool:
        """Whether nodes remain after those without incoming edges are taken away, again and again."""
        open_ = {i: sum(h != (0, 0) for h, _ in self.into[i]) for i in self.nodes}
        free = [i for i, k in open_.items() if not k]
        while free:
            for y, _ in self.out[free.pop()]:
                open_[y] -= 1
                if not open_[y]:
                    free.append(y)
        return any(open_.values())

    def components(self) -> list[set[Id]]:
        """Weakly connected parts, without the root, largest first."""
        left, parts = set(self.nodes), []
        while left:
            stack, part = [left.pop()], set()
            while stack:
                x = stack.pop()
                part.add(x)
                near = {y for y, _ in self.out[x]} | {h for h, _ in self.into[x]}
                stack += near & left
                left -= near
            parts.append(part)
        return sorted(parts, key=lambda p: (-len(p), min(p)))


class Edges:
    """The enhanced edges of a batch of sentences as columns, in order of nodes; `odd` tells sentences that only Graph reads rightly.

    Odd are sentences with ids given twice, heads or ids in another spelling than their numbers', edges given twice or
    without a colon, short lines and such as begin beyond ASCII. `node` is an edge's node: a number into `of` (sentence), `id`, `empty`.
    """

    def __init__(self, raw: pa.Array) -> None:
        self.nodes = nodes = cells.Nodes(raw)
        kept = pa.array(~nodes.ranged)
        odd = np.zeros(len(raw), bool)
        odd[nodes.of[nodes.many < 10]] = True
        odd[nodes.foreign] = True
        self.of, self.empty = nodes.of[~nodes.ranged], nodes.empty[~nodes.ranged]
        self.id, self.basic_head, self.basic_rel = (nodes[c].filter(kept) for c in ("id", "head", "deprel"))
        deps = nodes["deps"].filter(kept)
        plain = lambda x: cells.like(x, r"\A(0|[1-9][0-9]{0,8})(\.[1-9][0-9]{0,8})?\z")
        there = np.flatnonzero(np.asarray(pc.not_equal(deps, "_")))
        local, self.edge = cells.split(deps.take(pa.array(there)), "|")
        self.node = there[local]
        self.sentence = self.of[self.node]
        odd[self.sentence[~np.asarray(pc.match_substring(self.edge, ":"))]] = True
        self.head, self.label = cells.parted(self.edge)
        odd[self.of[~plain(self.id)]] = True
        odd[self.sentence[~plain(self.head)]] = True
        # A basic head counts where it is a number.
        digits = cells.like(self.basic_head, r"\A\pN+\z")
        odd[self.of[digits & (~plain(self.basic_head) | np.asarray(pc.match_substring(self.basic_head, ".")))]] = True
        self.basic = digits & ~self.empty
        self.count = np.bincount(self.node, minlength=len(self.of))
        # What a node or a sentence has twice.
        codes = np.asarray(self.id.dictionary_encode().indices, dtype=np.int64) if len(self.id) else np.zeros(0, np.int64)
        odd[_twice(self.of, codes)] = True
        several = self.count[self.node] > 1
        if several.any():
            labels = np.asarray(self.edge.filter(pa.array(several)).dictionary_encode().indices, dtype=np.int64)
            odd[self.of[_twice(self.node[several], labels)]] = True
        self.odd = odd

    def sources(self) -> np.ndarray:
        """Of each edge: the node that is its head, -1 for the root, -2 where there is none."""
        known = pa.concat_arrays([self.id, self.head]).dictionary_encode()
        code = np.asarray(known.indices, dtype=np.int64) if len(known) else np.zeros(0, np.int64)
        many = len(known.dictionary) + 1
        own, asked = self.of * many + code[: len(self.of)], self.sentence * many + code[len(self.of) :]
        order = np.argsort(own, kind="stable")
        at = np.minimum(np.searchsorted(own[order], asked), max(len(own) - 1, 0))
        found = np.where(own[order][at] == asked, order[at], -2) if len(own) else np.zeros(0, np.int64)
        found[np.asarray(pc.equal(self.head, "0"))] = -1
        return found

    def of_basic(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each edge: whether it has its node's basic head, the same label, and the same universal relation."""
        at = pa.array(self.node)
        there = self.basic[self.node] & np.asarray(pc.equal(self.head, self.basic_head.take(at)))
        rel = self.basic_rel.take(at)
        return there, np.asarray(pc.equal(self.label, rel)), np.asarray(pc.equal(universals(self.label), universals(rel)))


def universals(labels: pa.Array) -> pa.Array:
    known = labels.dictionary_encode()
    return pc.replace_substring_regex(known.dictionary, r"(?s):.*", "").take(known.indices)


def _twice(group: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The groups that hold a code more than once."""
    both = np.sort(group * (int(code.max(initial=0)) + 1) + code)
    return both[1:][both[1:] == both[:-1]] // (int(code.max(initial=0)) + 1)


PROPERTIES = (
    "graphs", "nodes_overt", "nodes_empty", "edges", "singletons", "indegree_over_1", "top_only_0", "top_also_others", "independent", "cyclic", "unconnected",
    "edge_basic_only", "edge_same", "edge_subtype", "edge_incompatible", "edge_enhanced_only",
    "gapping", "conj_parent", "conj_dependent", "xsubj", "relcl", "case_deprel",
)


def properties_of(raw: str) -> dict[str, int]:
    g = Graph(raw)
    n = dict.fromkeys(PROPERTIES, 0)
    n["graphs"] = 1
    for node in g.tree.enhanced:
        i = node.id
        into, out = g.into[i], g.out[i]
        n["nodes_empty" if node.kind == "empty" else "nodes_overt"] += 1
        inner = [h for h, _ in into if h != (0, 0)]
        n["edges"] += len(inner)
        n["singletons"] += not inner and not out and not into
        n["indegree_over_1"] += len(into) > 1
        if any(h == (0, 0) for h, _ in into):
            n["top_also_others" if inner else "top_only_0"] += 1
        n["independent"] += not into and bool(out)
        basic = g.basic.get(i)
        found = False
        for h, d in into:
            if basic is None or h != basic[0]:
                n["edge_enhanced_only"] += 1
                continue
            found = True
            n["edge_same" if d == basic[1] else "edge_subtype" if universal(d) == universal(basic[1]) else "edge_incompatible"] += 1
        n["edge_basic_only"] += basic is not None and not found
        n["gapping"] += node.kind == "empty"
        conj = [universal(d) == "conj" for _, d in into]
        n["conj_parent"] += len(into) >= 2 and any(conj) and not all(conj)
        parents = {h for (h, _), c in zip(into, conj) if not c}
        n["conj_dependent"] += len(into) >= 2 and any(universal(d) == "conj" and gp in parents for h in parents for gp, d in g.into[h])
        n["xsubj"] += any(
            universal(d) == "nsubj" and universal(x) == "xcomp" and any(c == i and universal(r) in ("nsubj", "obj", "iobj") for c, r in g.out[gp])
            for h, d in into for gp, x in g.into[h]
        )
        n["relcl"] += any(universal(d) == "ref" for _, d in into)
        unusual = any(re.search(r":.*:|[^a-z:]", d) for _, d in into)
        n["case_deprel"] += unusual or (basic is not None and any(h == basic[0] and d.startswith(basic[1] + ":") and len(d) > len(basic[1]) + 1 for h, d in into))
    n["cyclic"] = int(g.cyclic())
    n["unconnected"] = int(sum(len(p) > 1 for p in g.components()) > 1)
    return {k: int(v) for k, v in n.items()}


def properties(sentences: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A row of counts for each sentence (keys, raw)."""
    return per_sentence(sentences.select(*keys, "raw"), keys, lambda raw: [tuple(properties_of(raw).values())], ", ".join(f"{p} long" for p in PROPERTIES))


#: What edges and nodes tell one by one.
COUNTS = ("nodes_empty", "edge_same", "edge_subtype", "edge_incompatible", "edge_enhanced_only", "relcl")


def counts(sentences: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The columns COUNTS of properties(), by Arrow batches; odd sentences are walked."""

    def step(raw: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        e = Edges(raw)
        there, same, alike = e.of_basic()
        total = lambda which, of: np.bincount(of[which], minlength=len(raw))
        ref = np.unique(e.node[np.asarray(pc.equal(universals(e.label), "ref"))])
        found = np.stack([
            total(e.empty, e.of), total(there & same, e.sentence), total(there & ~same & alike, e.sentence), total(there & ~same & ~alike, e.sentence), total(~there, e.sentence), np.bincount(e.of[ref], minlength=len(raw)),
        ])
        for k in np.flatnonzero(e.odd):
            walked = properties_of(raw[k].as_py())
            found[:, k] = [walked[c] for c in COUNTS]
        return np.arange(len(raw)), [pa.array(x) for x in found]

    return cells.per_batch(sentences, keys, step, ", ".join(f"{c} long" for c in COUNTS))


def survey(rows: DataFrame, by: str) -> DataFrame:
    """Counts by treebank, with whether it has any and all kinds of enhancement."""
    kinds = ("gapping", "conj_parent", "conj_dependent", "xsubj", "relcl", "case_deprel")
    sums = rows.groupBy(by).agg(*(F.sum(p).alias(p) for p in PROPERTIES))
    return sums.withColumn("has_any", F.greatest(*kinds) > 0).withColumn("has_all", F.least(*kinds) > 0)


#: The letters of edge types.
TYPES = {"basic": "B", "cased": "C", "relabeled": "L", "gapping": "G", "orphan": "O", "coparent": "P", "codepend": "S", "xsubj": "X", "relcl": "R", "relpron": "W", "missing": "M", "enhanced": "E"}


def reasons(g: Graph, i: Id, h: Id, d: str) -> set[str]:
    """Why an edge exists that the basic tree does not have."""
    into, rel = g.into[i], universal(d)
    others = [(o, r) for o, r in into if o != h]
    out = set()
    if rel != "conj":
        if any(universal(r) == "conj" and any(x == h for x, _ in g.into[o]) for o, r in others):
            out.add("coparent")
        plain = {o for o, r in others if universal(r) != "conj"}
        if any(universal(r) == "conj" and gp in plain for gp, r in g.into[h]):
            out.add("codepend")
        if any(universal(r) == "acl" for _, r in g.out[i]) and g.path(i, h):
            out.add("relcl")
    if rel in ("nsubj", "csubj"):
        if any(universal(r) in ("nsubj", "csubj", "obj", "iobj", "obl") and any(c == h and universal(x) == "xcomp" for c, x in g.out[o]) for o, r in others):
            out.add("xsubj")
        if any(universal(r) in ("nsubj", "csubj") and any(x == h and universal(y) == "acl" for x, y in g.into[o]) for o, r in others):
            out.add("relcl")
    if rel == "ref":
        out.add("relcl")
    return out


def edge_types(raw: str) -> Iterator[tuple[str, str, str, str]]:
    """(child, parent, relation, letters) of every enhanced edge, and of basic edges that the graph lacks."""
    g = Graph(raw)
    for node in g.tree.enhanced:
        i, basic = node.id, g.basic.get(node.id)
        found = bridged = referred = False
        for h, d in g.into[i]:
            if basic is not None and h == basic[0] and universal(d) != "ref":
                if ">" in d and d != basic[1]:
                    kinds, bridged = {"gapping"}, True
                else:
                    kinds, found = {"basic" if d == basic[1] else "cased" if universal(d) == universal(basic[1]) else "relabeled"}, True
            else:
                kinds = reasons(g, i, h, d)
                referred |= universal(d) == "ref"
                if basic is None or h[1] or ">" in d:
                    kinds = kinds | {"gapping"}
                    bridged = True
                kinds = kinds or {"enhanced"}
            yield id_text(i), id_text(h), d, "".join(sorted(TYPES[k] for k in kinds))
        if basic is not None and not found:
            yield id_text(i), id_text(basic[0]), basic[1], TYPES["orphan" if bridged else "relpron" if referred else "missing"]


def classified(sentences: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """edge_types() of each sentence, by Arrow batches; walked are the odd ones and those with an added edge whose reasons its neighbours decide."""

    def step(raw: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        e = Edges(raw)
        there, same, alike = e.of_basic()
        rel = universals(e.label)
        ref, conj = (np.asarray(pc.equal(rel, x)) for x in ("ref", "conj"))
        inherited = there & ~ref
        pathed = np.asarray(pc.match_substring(e.label, ">"))
        bridging = inherited & pathed & ~same
        known = inherited & ~bridging
        added = ~inherited
        gapping = added & (~e.basic[e.node] | np.asarray(pc.match_substring(e.head, ".")) | pathed)
        # Reasons need the node's other edges, or a path from a word that a clause below it hangs on.
        acl = pa.array(np.flatnonzero(np.asarray(pc.equal(rel, "acl"))))
        heads = pa.array(e.sentence[np.asarray(acl)]).cast(pa.string()), e.head.take(acl)
        own = pa.array(e.of).cast(pa.string())
        above = np.asarray(pc.is_in(pc.binary_join_element_wise(own, e.id, " "), value_set=pc.binary_join_element_wise(*heads, " "))) if len(acl) else np.zeros(len(e.of), bool)
        walked = e.odd.copy()
        walked[e.sentence[added & ~conj & ((e.count[e.node] > 1) | above[e.node])]] = True

        letters = np.full(len(e.node), "E", object)
        letters[known & same], letters[known & ~same & alike], letters[known & ~same & ~alike] = "B", "C", "L"
        letters[added & ref], letters[gapping & ~ref], letters[gapping & ref], letters[bridging] = "R", "G", "GR", "G"
        holds = lambda which: np.bincount(e.node[which], minlength=len(e.of)) > 0
        lost = e.basic & ~holds(known)
        left = np.where(holds(bridging | gapping), "O", np.where(holds(added & ref), "W", "M"))
        edges, missing = ~walked[e.sentence], lost & ~walked[e.of]
        mask, gone = pa.array(edges), pa.array(missing)
        of = [e.sentence[edges], e.of[missing]]
        columns = [
            [e.id.take(pa.array(e.node[edges])), e.id.filter(gone)], [e.head.filter(mask), e.basic_head.filter(gone)], [e.label.filter(mask), e.basic_rel.filter(gone)],
            [pa.array(letters[edges], pa.string()), pa.array(left[missing].astype(object), pa.string())],
        ]
        for k in np.flatnonzero(walked):
            found = list(edge_types(raw[k].as_py()))
            of.append(np.full(len(found), k))
            for c, values in zip(columns, zip(*found)):
                c.append(pa.array(values, pa.string()))
        return np.concatenate(of).astype(np.int64), [pa.concat_arrays(c) for c in columns]

    return cells.per_batch(sentences, keys, step, "child string, parent string, deprel string, types string")


def direct_edges(sentences: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, child, parent, deprel: collapsed_edges() of each sentence, by Arrow batches; walked are the odd ones and those with a word below an empty node."""

    def step(raw: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        e = Edges(raw)
        word = ~e.empty[e.node]
        walked = e.odd.copy()
        walked[e.sentence[word & np.asarray(pc.match_substring(e.head, "."))]] = True
        kept = word & ~walked[e.sentence]
        mask = pa.array(kept)
        of, columns = [e.sentence[kept]], [[e.id.take(pa.array(e.node[kept]))], [e.head.filter(mask)], [e.label.filter(mask)]]
        for k in np.flatnonzero(walked):
            found = [(str(c[0]), str(p[0]), d) for p, c, d in collapsed_edges(raw[k].as_py())]
            of.append(np.full(len(found), k))
            for c, values in zip(columns, zip(*found)):
                c.append(pa.array(values, pa.string()))
        return np.concatenate(of).astype(np.int64), [pa.concat_arrays(c) for c in columns]

    return cells.per_batch(sentences, keys, step, "child string, parent string, deprel string")


def type_totals(edges: DataFrame, *by: str) -> DataFrame:
    """Edges by letter, and the sums basic, enhanced, relabeled, added, removed."""
    rows = edges.select(*by, F.explode(F.split("types", "")).alias("type"))
    of = lambda letters: F.count_if(F.col("type").isin(*letters))
    return rows.groupBy(*by).agg(*(of(v).alias(k) for k, v in TYPES.items()), of("BCLOWM").alias("n_basic"), of("BCLGPSXRE").alias("n_enhanced"), of("CL").alias("n_relabeled"), of("GPSXRE").alias("n_added"), of("OWM").alias("n_removed"))


def annotated(raw: str) -> str:
    """The sentence with `Edep=letters:parent:relation` in MISC, in order of parents."""
    marks: dict[str, list[tuple[Id, str, str]]] = {}
    for child, parent, d, letters in edge_types(raw):
        marks.setdefault(child, []).append((id_of(parent), d, letters))
    tree = Tree(raw)
    for n in tree.enhanced:
        if n.cells[0] in marks:
            kept = [x for x in n.misc.split("|") if x != "_" and not x.startswith("Edep=")]
            n.cells[9] = "|".join(kept + [f"Edep={letters}:{id_text(p)}:{d}" for p, d, letters in sorted(marks[n.cells[0]])])
    return tree.rendered()


def collapsed_edges(raw: str) -> list[Edge]:
    """Edges between words, where every path through empty nodes is one edge named by its relations.

    A path visits an empty node at most once, so cycles among empty nodes end; edges are by child and parent.
    """
    g = Graph(raw)
    out = []
    for node in g.tree.enhanced:
        if node.kind == "empty":
            continue
        stack = [(h, d, frozenset()) for h, d in g.into[node.id]]
        while stack:
            h, d, seen = stack.pop()
            if not h[1]:
                out.append((h, node.id, d))
            elif h not in seen:
                stack += [(h2, f"{d2}>{d}", seen | {h}) for h2, d2 in g.into[h]]
    return sorted(set(out), key=lambda e: (e[1], e[0], e[2]))


def collapsed(raw: str) -> str:
    """The sentence without empty nodes; their paths are in DEPS."""
    edges: dict[Id, list[str]] = {}
    for h, c, d in collapsed_edges(raw):
        edges.setdefault(c, []).append(f"{id_text(h)}:{d}")
    tree = Tree(raw)
    tree.nodes = [n for n in tree.nodes if n.kind != "empty"]
    for n in tree.enhanced:
        n.cells[8] = "|".join(edges.get(n.id, [])) or "_"
    return tree.rendered()


def reachable(raw: str) -> str:
    """Attaches nodes to the root until all can be reached: each time the first, as text, of those that cannot."""
    g = Graph(raw)
    seen, added = set(), set()
    stack = [(0, 0)]
    while True:
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += (y for y, _ in g.out[x])
        left = [i for i in g.nodes if i not in seen]
        if not left:
            break
        first = min(left, key=id_text)
        added.add(first)
        stack.append(first)
    for n in g.tree.enhanced:
        if n.id in added:
            n.cells[8] = "0:root" if n.deps == "_" else f"0:root|{n.deps}"
    return g.tree.rendered()


def acyclic(raw: str) -> str:
    """Cuts cycles of the basic tree: the edge that closes one goes to the root, and its parent to MISC `Cycle=`."""
    tree = Tree(raw)
    heads = [0, *(int(n.head) if n.head.isdigit() and int(n.head) < len(tree.words) else 0 for n in tree.words[1:])]
    done = [True] + [False] * (len(heads) - 1)
    for i in range(1, len(heads)):
        walk, j = [], i
        while not done[j] and j not in walk:
            walk.append(j)
            j = heads[j]
        if not done[j]:
            last = tree.words[walk[-1]]
            heads[walk[-1]], last.cells[6] = 0, "0"
            kept = [x for x in last.misc.split("|") if x != "_"]
            before = [x for x in kept if x.startswith("Cycle=")]
            last.cells[9] = "|".join([x for x in kept if x not in before] + [f"{before[-1]}:{j}" if before else f"Cycle={j}"])
        for k in walk:
            done[k] = True
    return tree.rendered()


def shape_of(raw: str) -> tuple[int, int, int, int]:
    """Depth of the tree, words that the root does not reach, words with a gap to their parent, and most children of a word."""
    tree = Tree(raw)
    depth = {tree.root: 0}
    order = [tree.root]
    for n in order:
        for c in n.children:
            depth[c] = depth[n] + 1
            order.append(c)
    below: dict = {n: {n.id[0]} for n in order}
    for n in reversed(order):
        if n.parent is not None:
            below[n.parent] |= below[n]
    gaps = sum(any(k not in below[n.parent] for k in range(min(n.id[0], n.parent.id[0]) + 1, max(n.id[0], n.parent.id[0]))) for n in order[1:])
    return max(depth.values()), len(tree.words) - len(order), gaps, max(len(n.children) for n in tree.words)


def shapes(sentences: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return per_sentence(sentences.select(*keys, "raw"), keys, lambda raw: [shape_of(raw)], "depth int, n_unreached int, n_nonprojective int, max_children int")


#: Rounds in which the first node that reaches another one is handed on; what is not settled by then is walked.
ROUNDS = 64


def _texts(raw: pa.Array, plain: pa.Array, walked: np.ndarray, walk: Callable[[str], str]) -> tuple[np.ndarray, list[pa.Array]]:
    """`plain`, and the walk's text of walked sentences."""
    if walked.any():
        at = pa.array(np.flatnonzero(walked))
        plain = pc.replace_with_mask(plain, pa.array(walked), pa.array([walk(x) for x in raw.take(at).to_pylist()], pa.string()))
    return np.arange(len(raw)), [plain]


def reachable_sentences(sentences: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """reachable() of each sentence (keys, raw), by Arrow batches.

    All graphs are searched from their roots at once. Of the nodes that are left, those are attached that none before them,
    as text, reaches: the first that reaches a node is handed on along the edges. Odd sentences are walked.
    """

    def step(raw: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        e = Edges(raw)
        e.odd[e.nodes.of[e.nodes.many != 10]] = True
        e.odd[e.of[np.asarray(pc.equal(e.id, "0"))]] = True
        source = e.sources()
        first = np.array(pc.rank(e.id, tiebreaker="dense"), dtype=np.int64) if len(e.id) else np.zeros(0, np.int64)
        own = first.copy()
        order = np.argsort(source, kind="stable")
        begins, ends = (np.searchsorted(source[order], np.arange(-2, len(e.of)), side=x) for x in ("left", "right"))
        following = lambda at: order[np.concatenate([p for _, p in ranges(begins[at + 2], ends[at + 2])] or [at[:0]])]
        reached = np.zeros(len(e.of), bool)
        front = np.unique(e.node[following(np.array([-1]))])
        while len(front):
            reached[front] = True
            to = e.node[following(front)]
            front = np.unique(to[~reached[to]])
        front = np.flatnonzero(~reached)
        for _ in range(ROUNDS):
            edge = following(front)
            before, to = first.copy(), e.node[edge]
            np.minimum.at(first, to, first[source[edge]])
            front = np.unique(to[(first[to] < before[to]) & ~reached[to]])
            if not len(front):
                break
        e.odd[e.of[front]] = True
        added = np.flatnonzero(~reached & (first == own))
        deps, at = e.nodes["deps"], np.flatnonzero(~e.nodes.ranged)[added]
        old = deps.take(pa.array(at))
        mask = np.zeros(len(deps), bool)
        mask[at] = True
        new = pc.if_else(pc.equal(old, "_"), "0:root", pc.binary_join_element_wise("0:root|", old, ""))
        return _texts(raw, e.nodes.rendered({"deps": pc.replace_with_mask(deps, pa.array(mask), new)}), e.odd, reachable)

    return cells.per_batch(sentences, keys, step, "raw string")


def collapsed_sentences(sentences: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """collapsed() of each sentence (keys, raw), by Arrow batches; walked are the odd ones and those with a word below an empty node."""

    def step(raw: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        e = Edges(raw)
        walked = e.odd.copy()
        walked[e.nodes.of[e.nodes.many != 10]] = True
        walked[e.sentence[~e.empty[e.node] & np.asarray(pc.match_substring(e.head, "."))]] = True
        nodes = e.nodes
        word = nodes.word & ~walked[nodes.of]
        deps = pc.replace_with_mask(nodes["deps"], pa.array(word), cells.sorted_edges(nodes["deps"].filter(pa.array(word))))
        return _texts(raw, nodes.rendered({"deps": deps}, ~nodes.empty), walked, collapsed)

    return cells.per_batch(sentences, keys, step, "raw string")


def rewritten(sentences: DataFrame, keys: tuple[str, ...], step) -> DataFrame:
    """Sentences whose raw text `step` has changed."""
    return per_sentence(sentences.select(*keys, "raw"), keys, lambda raw: [(step(raw),)], "raw string")
