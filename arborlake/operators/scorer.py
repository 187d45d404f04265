"""Scores of a system's treebank against the gold one: spans, word alignment, fifteen metrics.

Characters are the common ground: every word gets its place in its document's characters, and the versions meet
there. Both sides' documents meet once (operators.versions), many at a time; words that belong together are aligned,
and what the metrics ask of them (tags, parents, functional children, enhanced edges) are comparisons of Arrow and NumPy
columns. Counts alone leave a task. Only paths through empty nodes and the common sequences inside overlapping
ranges are walked in Python. words() is the same view of words as rows, for callers who join them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions import universal, without_spaces
from arborlake.operators import graphs, offsets, versions
from arborlake.operators.sentence import Id, Tree
from arborlake.operators.sentence import universal as universal_of
from arborlake.sources import cells

# Relations that count as content or as function words, and universal features.
CONTENT = {"nsubj", "obj", "iobj", "csubj", "ccomp", "xcomp", "obl", "vocative", "expl", "dislocated", "advcl", "advmod", "discourse", "nmod", "appos", "nummod", "acl", "amod", "conj", "fixed", "flat", "compound", "list", "parataxis", "orphan", "goeswith", "reparandum", "root", "dep"}
FUNCTIONAL = {"aux", "cop", "mark", "det", "clf", "case", "cc"}
FEATURES = {
    "PronType", "NumType", "Poss", "Reflex", "Foreign", "Abbr", "Gender", "Animacy", "Number", "Case", "Definite", "Degree", "VerbForm", "Mood",
    "Tense", "Aspect", "Voice", "Evident", "Polarity", "Person", "Polite",
}
METRICS = ("Tokens", "Sentences", "Words", "UPOS", "XPOS", "UFeats", "AllTags", "Lemmas", "UAS", "LAS", "ELAS", "EULAS", "CLAS", "MLAS", "BLEX")
#: The path of an edge that passes no empty node has one relation.
JOINT = ">"


def words(laid: DataFrame, doc: tuple[str, ...], order: str) -> DataFrame:
    """A row for each word: doc, place (sent, id), parent (its place; null: the root), start, end, ranged, lower, tags, and how many functional children it has."""
    features = F.array_join(F.array_sort(F.filter(F.split("feats", r"\|"), lambda x: F.substring_index(x, "=", 1).isin(*FEATURES))), "|")
    head = F.col("head").try_cast("int")
    rows = laid.where("kind = 'word'").select(
        *doc, F.struct(F.col(order).alias("sent"), F.col("major").alias("id")).alias("place"), F.when(head > 0, F.struct(F.col(order).alias("sent"), head.alias("id"))).alias("parent"),
        "start", "end", "ranged", F.lower("form").alias("lower"), "lemma", "upos", "xpos", features.alias("feats"), universal(F.col("deprel")).alias("rel"),
    )
    helpers = rows.where(F.col("rel").isin(*FUNCTIONAL) & F.col("parent").isNotNull()).groupBy(*doc, F.col("parent").alias("place")).agg(F.count("*").alias("helpers"))
    return rows.join(helpers, [*doc, "place"], "left").withColumn("helpers", F.coalesce("helpers", F.lit(0)))


def paths(raw: str, undone: bool = False) -> list[tuple[int, int, str]]:
    """(word, head, relations on the path from the head through empty nodes) of every enhanced edge; `undone`: words reached through empty nodes hang as in the tree instead."""
    tree = Tree(raw)
    empties = {n.id: n for n in tree.nodes if n.kind == "empty"}
    out = []
    for n in tree.words[1:]:
        found: set[tuple[Id, tuple[str, ...]]] = set()
        stack = [(h, (d,), frozenset()) for h, d in n.edges]
        while stack:
            h, path, seen = stack.pop()
            if h not in empties:
                found.add((h, path))
            elif h not in seen:
                stack += [(h2, (d2, *path), seen | {h}) for h2, d2 in empties[h].edges]
        if undone and any(len(p) > 1 for _, p in found):
            found = {x for x in found if len(x[1]) == 1} or {((int(n.head), 0) if n.head.isdigit() else (0, 0), (n.deprel,))}
        out += [(n.id[0], h[0], JOINT.join(p)) for h, p in sorted(found)]
    return out


def path_cells(raw: pa.Array, nodes: cells.Nodes, undone: bool) -> pa.Array:
    """The enhanced edges of each node as DEPS with the relations of paths(); `=`: the edge of the tree alone. Only sentences in odd spelling or with edges from empty nodes are walked."""
    edges = graphs.Edges(raw)
    walked = edges.odd.copy()
    walked[edges.sentence[np.asarray(pc.match_substring(edges.head, "."))]] = True
    deps, rows = nodes["deps"], np.flatnonzero(walked)
    deps = pc.if_else(pc.equal(deps, pc.binary_join_element_wise(nodes["head"], nodes["deprel"], ":")), "=", deps)
    if not len(rows):
        return deps
    found: dict[tuple[int, int], list[str]] = {}
    for i, text in zip(rows.tolist(), raw.take(pa.array(rows)).to_pylist()):
        for word, head, path in paths(text, undone):
            found.setdefault((i, word), []).append(f"{head}:{path}")
    at = np.flatnonzero(walked[nodes.of])
    # The first word of an id has its edges.
    new = ["|".join(found.pop((i, versions.number(x)), ())) if word else "" for i, x, word in zip(nodes.of[at].tolist(), nodes["id"].take(pa.array(at)).to_pylist(), nodes.word[at].tolist())]
    return pc.replace_with_mask(deps, pa.array(walked[nodes.of]), pa.array([x or "_" for x in new], pa.string()))


class Words:
    """The words of one side: numbers of nodes with their documents, places, and parents (-1: the root, -2: no word)."""

    def __init__(self, side: versions.Side, bad: np.ndarray) -> None:
        self.side = side
        self.at = np.flatnonzero(side.word & ~bad[side.doc])
        self.doc, self.sent, self.major, self.start, self.end, self.ranged = (x[self.at] for x in (side.doc, side.sent, side.major, side.start, side.end, side.ranged))
        key = (self.sent << 32) + self.major
        self.by = np.argsort(key, kind="stable")
        self.key = key[self.by]
        self.parent = self.found(self.sent, versions.numbers(self["head"]))

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, column: str) -> pa.Array:
        return self.side[column].take(pa.array(self.at))

    def found(self, sent: np.ndarray, head: np.ndarray) -> np.ndarray:
        """The word that is meant by a head in a sentence."""
        if not len(self):
            return np.where(head > 0, -2, -1)
        key = (sent << 32) + head
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(head <= 0, -1, np.where(self.key[at] == key, self.by[at], -2))

    def edges(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Word, parent and path of each enhanced edge."""
        deps = self["deps"]
        same = pc.equal(deps, "=")
        if pc.any(same).as_py():
            at = pa.array(np.flatnonzero(np.asarray(same)))
            deps = pc.replace_with_mask(deps, same, pc.binary_join_element_wise(self["head"].take(at), self["deprel"].take(at), ":"))
        there = np.flatnonzero(np.asarray(pc.not_equal(deps, "_")))
        of, edge = cells.split(deps.take(pa.array(there)), "|")
        head, path = cells.parted(edge)
        return there[of], self.found(self.sent[there[of]], versions.numbers(head)), path


def met(g: Words, s: Words) -> tuple[np.ndarray, np.ndarray]:
    """offsets.aligned() of the words of many documents: the numbers of those that belong together."""
    spans = np.unique(np.concatenate([np.stack([x.start[x.ranged], x.end[x.ranged]], 1) for x in (g, s)]), axis=0)
    until = np.maximum.accumulate(spans[:, 1])
    fresh = np.ones(len(spans), bool)
    fresh[1:] = until[:-1] <= spans[1:, 0]
    low, high = spans[fresh, 0], until[np.append(np.flatnonzero(fresh)[1:], len(spans)) - 1] if len(spans) else until

    def island(x: Words) -> np.ndarray:
        at = np.searchsorted(low, x.start, "right") - 1
        return np.where((at >= 0) & (x.end <= high[at]), at, -1) if len(low) else np.full(len(x), -1)

    inside = [island(x) for x in (g, s)]
    # Outside, words of equal places pair in order.
    at = [np.flatnonzero(x < 0) for x in inside]
    start, end = (np.concatenate([getattr(x, c)[i] for x, i in zip((g, s), at)]) for c in ("start", "end"))
    which, side = np.concatenate(at), np.repeat([0, 1], [len(x) for x in at])
    by = np.lexsort((which, side, end, start))
    start, end, which, side = start[by], end[by], which[by], side[by]
    new = np.ones(len(by), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (side[1:] != side[:-1])
    nth = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    by = np.lexsort((side, nth, end, start))
    start, end, which, side, nth = start[by], end[by], which[by], side[by], nth[by]
    pair = np.flatnonzero((start[1:] == start[:-1]) & (end[1:] == end[:-1]) & (nth[1:] == nth[:-1]))
    a, b = [which[pair]], [which[pair + 1]]
    held: list[list[tuple[int, list[tuple[int, str]]]]] = []
    for x, of in zip((g, s), inside):
        i = np.flatnonzero(of >= 0)
        i = i[np.argsort(of[i], kind="stable")]
        forms = [f.lower() for f in x["form"].take(pa.array(i)).to_pylist()]
        cut = np.flatnonzero(np.diff(of[i], prepend=-1)).tolist()
        held.append([(int(of[i[p]]), i[p:q], forms[p:q]) for p, q in zip(cut, [*cut[1:], len(i)])])
    other = {number: (i, forms) for number, i, forms in held[1]}
    for number, i, forms in held[0]:
        if number in other:
            j, theirs = other[number]
            if forms == theirs:
                a.append(i)
                b.append(j)
            elif p := np.array(offsets.longest(forms, theirs), np.int64).reshape(-1, 2).T.tolist():
                a.append(i[p[0]])
                b.append(j[p[1]])
    return np.concatenate(a), np.concatenate(b)


def _shared(a: list[np.ndarray], b: list[np.ndarray], each: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places in `a` of the rows that both tables (columns of equal length) have, and each()(times in a, times in b)."""
    columns = [np.concatenate(x) for x in zip(a, b)]
    by = np.lexsort(columns[::-1])
    new = np.ones(len(by), bool)
    new[1:] = np.logical_or.reduce([c[by][1:] != c[by][:-1] for c in columns])
    group, mine = np.cumsum(new) - 1, by < len(a[0])
    size = int(new.sum())
    times = each(np.bincount(group[mine], minlength=size), np.bincount(group[~mine], minlength=size))
    return by[np.flatnonzero(new)][times > 0], times[times > 0]


def _features(cell: str) -> str:
    return "|".join(sorted(x for x in cell.split("|") if x.partition("=")[0] in FEATURES))


def _universal_path(path: str) -> str:
    return JOINT.join(universal_of(x) for x in path.split(JOINT))


def counted(g: versions.Side, s: versions.Side, docs: int, by: np.ndarray) -> dict[str, tuple[np.ndarray, ...]]:
    """For each metric n_gold, n_system, n_correct, n_aligned of each group of documents; `by` has the documents' groups."""
    groups = int(by.max(initial=-1)) + 1
    add = lambda at, n=None: np.bincount(by[at], n, groups).astype(np.int64)
    bad = versions.differing(g, s, docs)
    none = add(np.zeros(0, np.int64))
    out = {"Mismatch": (add(np.flatnonzero(bad)),) * 2 + (none, none)}

    def spans(metric: str, sides: list[tuple[np.ndarray, ...]]) -> None:
        """From documents, begins and ends: equal places, as often as both sides have them."""
        (a, *x), (b, *y) = sides
        first, times = _shared(list(x), list(y), np.minimum)
        out[metric] = add(a), add(b), add(a[first], times), none

    tokens, sentences = [], []
    for x in (g, s):
        at = np.flatnonzero(~x.ranged & ~bad[x.doc])
        tokens.append((x.doc[at], x.start[at], x.end[at]))
        low, high = np.full(len(x.order), np.iinfo(np.int64).max), np.full(len(x.order), -1)
        np.minimum.at(low, x.sent, x.start)
        np.maximum.at(high, x.sent, x.end)
        at = np.flatnonzero((high >= 0) & ~bad[x.sent_doc])
        sentences.append((x.sent_doc[at], low[at], high[at]))
    spans("Tokens", tokens)
    spans("Sentences", sentences)

    a, b = Words(g, bad), Words(s, bad)
    pg, ps = met(a, b)
    moved = np.full(len(b) + 1, -3)  # the gold word of a system's word; the last is none's
    moved[ps] = pg
    gp, sp = a.parent[pg], b.parent[ps]
    attached = ((gp == -1) & (sp == -1)) | ((gp >= 0) & (gp == moved[np.where(sp >= 0, sp, len(b))]))
    change = {"deprel": universal_of, "feats": _features}
    code = {c: versions.coded(a[c], b[c], change.get(c)) for c in ("lemma", "upos", "xpos", "feats", "deprel")}
    same = {c: x[pg] == y[ps] for c, (x, y, _) in code.items()}
    rel, other_rel, names = code["deprel"]
    content, functional = (np.array([x in kinds for x in names], bool) for kinds in (CONTENT, FUNCTIONAL))
    helpers = lambda x, r: np.bincount(x.parent[functional[r] & (x.parent >= 0)], minlength=len(x))
    right = np.bincount(gp[attached & (gp >= 0) & functional[rel[pg]] & same["deprel"] & same["upos"] & same["feats"]], minlength=len(a))
    labelled = attached & same["deprel"]
    lemma = same["lemma"] | np.asarray(pc.equal(a["lemma"], "_"))[pg]
    helped = (helpers(a, rel)[pg] == helpers(b, other_rel)[ps]) & (helpers(a, rel)[pg] == right[pg])
    tests = {
        "Words": (np.ones(len(pg), bool), False), "UPOS": (same["upos"], False), "XPOS": (same["xpos"], False), "UFeats": (same["feats"], False), "AllTags": (same["upos"] & same["xpos"] & same["feats"], False), "Lemmas": (lemma, False),
        "UAS": (attached, False), "LAS": (labelled, False), "CLAS": (labelled, True), "MLAS": (labelled & same["upos"] & same["feats"] & helped, True), "BLEX": (labelled & lemma, True),
    }
    of = a.doc[pg]
    every, some = ((add(a.doc), add(b.doc), add(of)), (add(a.doc[content[rel]]), add(b.doc[content[other_rel]]), add(of[content[rel[pg]]])))
    for metric, (test, c) in tests.items():
        n, m, aligned = some if c else every
        out[metric] = n, m, add(of[test & content[rel[pg]] if c else test]), aligned

    # Enhanced edges: the system's, carried over to the gold words that its words are aligned with.
    (p, q, d), (x, y, e) = a.edges(), b.edges()
    carried = np.where(y >= 0, moved[np.where(y >= 0, y, len(b))], np.where(y == -1, -1, -3))
    kept = (moved[x] >= 0) & (carried > -3)
    for metric, plain in (("ELAS", None), ("EULAS", _universal_path)):
        d_code, e_code, _ = versions.coded(d, e, plain)
        first, times = _shared([p, q, d_code], [moved[x][kept], carried[kept], e_code[kept]], np.multiply)
        out[metric] = add(a.doc[p]), add(b.doc[x]), add(a.doc[p[first]], times), none
    return out


def scores(gold: DataFrame, system: DataFrame, keys: tuple[str, ...], order: str = "sent_no", by: tuple[str, ...] = (), undone: bool = False) -> DataFrame:
    """metric, n_gold, n_system, n_correct, n_aligned, precision, recall, f1, aligned_accuracy; documents are `keys`, `by` some of them.

    A document whose characters differ between the sides has metric `Mismatch` and counts in no other.
    `undone`: see paths().
    """
    numbers = ("n_gold", "n_system", "n_correct", "n_aligned")
    columns = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps")

    def step(docs: pa.Table, g: versions.Side, s: versions.Side) -> pa.Table:
        place: dict[tuple, int] = {}
        group = np.array([place.setdefault(x, len(place)) for x in (zip(*(docs.column(k).to_pylist() for k in by)) if by else [()] * docs.num_rows)], np.int64)
        rows = []
        all_counts = counted(g, s, docs.num_rows, group)
        words = [any(n) for n in zip(*all_counts["Words"])]  # a group with words has all metrics of words
        for metric, found in all_counts.items():
            always = metric in METRICS[2:] and metric not in ("ELAS", "EULAS")
            rows += [(*key, metric, *map(int, n)) for key, n, w in zip(place, zip(*found), words) if any(n) or (always and w)]
        return pa.table({c: pa.array([r[i] for r in rows], docs.schema.field(c).type if c in by else pa.string() if c == "metric" else pa.int64()) for i, c in enumerate((*by, "metric", *numbers))})

    deps = lambda raw, nodes: path_cells(raw, nodes, undone)
    sides = [versions.packed(x, keys, order, k, columns, deps) for k, x in enumerate((gold, system))]
    counts = versions.together(*sides, keys, (columns, columns), step, versions.schema_of(gold, by, "metric string, n_gold long, n_system long, n_correct long, n_aligned long"))
    if not by:  # without groups, all metrics but those of spans are always there
        zeros = gold.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, METRICS[2:]))).alias("metric"), *(F.lit(0).cast("long").alias(n) for n in numbers))
        counts = counts.unionByName(zeros)
    sums = counts.groupBy(*by, "metric").agg(*(F.sum(n).alias(n) for n in numbers))
    share = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 6), F.lit(0.0))
    return sums.select("*", share(F.col("n_correct"), F.col("n_system")).alias("precision"), share(F.col("n_correct"), F.col("n_gold")).alias("recall"), share(2 * F.col("n_correct"), F.col("n_gold") + F.col("n_system")).alias("f1"), share(F.col("n_correct"), F.col("n_aligned")).alias("aligned_accuracy"))


def table(rows: DataFrame, verbose: bool = True, counts: bool = False, enhanced: bool = False) -> DataFrame:
    """place, line: the scores as a report. In percent or as counts; not verbose: one line with the LAS, MLAS and BLEX alone. Enhanced metrics if asked for."""
    chosen = rows.where(F.col("metric").isin(*(m for m in METRICS if enhanced or m not in ("ELAS", "EULAS"))))
    place = F.array_position(F.array(*map(F.lit, METRICS)), F.col("metric"))
    if not verbose:
        brief = ("LAS", "MLAS", "BLEX", *(("ELAS",) if enhanced else ()))
        return chosen.where(F.col("metric").isin(*brief)).select(place.alias("place"), F.format_string("%s F1 Score: %.2f", "metric", 100 * F.col("f1")).alias("line"))
    if counts:
        cells = [F.lpad(F.col(c).cast("string"), 10, " ") for c in ("n_correct", "n_gold", "n_system", "n_aligned")]
        names = ("Correct", "Gold", "Predicted", "Aligned")
    else:
        cells = [F.lpad(F.format_number(100 * F.col(c), 2), 10, " ") for c in ("precision", "recall", "f1", "aligned_accuracy")]
        names = ("Precision", "Recall", "F1 Score", "AligndAcc")
    head = rows.sparkSession.createDataFrame([(0, " |".join([f"{'Metric':<11}", *(f"{n:>10}" for n in names)])), (1, "+".join(["-" * 11, *["-" * 11] * 4]))], "place long, line string")
    return head.unionByName(chosen.select((place + 1).alias("place"), F.concat_ws(" |", F.rpad("metric", 11, " "), *cells).alias("line")))


def same_characters(gold: DataFrame, system: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sentences (keys, text) whose texts differ between the sides beyond white space."""
    other = system.select(*keys, without_spaces(F.col("text")).alias("_text"))
    return gold.join(other, list(keys), "full").where(~without_spaces(F.col("text")).eqNullSafe(F.col("_text"))).select(*keys)
