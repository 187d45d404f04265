"""Validation: levels 1 to 5 of the checks, in the order in which each guards the next.

Most rules see one sentence. They run as one ordered chain for each sentence: a broken backbone stops the
chain, broken references or trees stop what needs a tree, a broken feature stops the sentence's metadata.
What spans sentences (unique ids, order of alternatives, all-or-none of enhanced graphs) needs facts of the
sentences that passed; the chain hands them out, and aggregates or windows over narrow rows decide.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from arborlake.operators import columns as by_columns
from arborlake.operators.sentence import EMPTY, RANGE, WORD, Node, Tree, edge_list, id_of, id_text, per_sentence, universal
from arborlake.sources.cells import SLICE
from arborlake.sources.scratch import written
from arborlake.sources.registry import RELATIONS, SAMPLE, UPOS, Language

# The languages of the format's cells and comments.
FEATURE = re.compile(r"([A-Z][A-Za-z0-9]*(?:\[[a-z0-9]+\])?)=([A-Z0-9][A-Za-z0-9]*(?:,[A-Z0-9][A-Za-z0-9]*)*)")
VALUE = re.compile(r"[A-Z0-9][A-Za-z0-9]*")
HEAD, ENHANCED_HEAD = re.compile(r"0|[1-9][0-9]*"), re.compile(r"(0|[1-9][0-9]*)(\.[1-9][0-9]*)?")
DEPREL = re.compile(r"[a-z]+(:[a-z]+)?")
_LETTERS = r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]+"
ENHANCED_DEPREL = regex.compile(rf"[a-z]+(:[a-z]+)?(:{_LETTERS}(_{_LETTERS})*)?(:[a-z]+)?")
SENT_ID = re.compile(r"#\s*sent_id\s*=\s*(\S+)")
PARALLEL_ID = re.compile(r"#\s*parallel_id\s*=\s*(([a-z]+)/([-0-9a-z]+)(?:/(alt[1-9][0-9]*|part[1-9][0-9]*|alt[1-9][0-9]*part[1-9][0-9]*))?)")
TEXT = re.compile(r"#\s*text\s*=\s*(.*)")
NEW = {k: re.compile(rf"#\s*{k}(?:\s+(?:id\s*=\s*)?(\S+))?") for k in ("newdoc", "newpar")}
MISC_NAMES = ("SpaceAfter", "Lang", "Translit", "LTranslit", "Gloss", "LId", "LDeriv", "Ref")

CLASSES = ("INTERNAL", "UNICODE", "FORMAT", "MORPHO", "SYNTAX", "ENHANCED", "COREF", "METADATA")
INCIDENT = "level int, type string, testclass string, testid string, line int, node string, message string"


class Found(NamedTuple):
    level: int
    type: str
    testclass: str
    testid: str
    line: int
    node: str
    message: str


def error(level: int, testclass: str, testid: str, at: Node | int, message: str = "") -> Found:
    return Found(level, "ERROR", testclass, testid, *((at.line, at.cells[0]) if isinstance(at, Node) else (at, "")), message)


def warning(*args) -> Found:
    return error(*args)._replace(type="WARNING")


@dataclass
class Sentence:
    """What the checks of one sentence share."""

    raw: str
    language: str
    registry: dict[str, Language]
    main: str = ""
    lines: list[str] = field(default_factory=list)
    comments: list[str] = field(default_factory=list)
    first: int = 1
    tree: Tree | None = None

    @property
    def nodes(self) -> list[Node]:
        return self.tree.nodes


# Level 1: lines, columns, ids. Each function yields findings and returns whether later checks may run.


def backbone(s: Sentence) -> Iterator[Found]:
    seen_node = seen_other = False
    ok = True
    for at, line in enumerate(s.lines, 1):
        if (composed := unicodedata.normalize("NFC", line)) != line:
            i = next((i for i, (a, b) in enumerate(zip(line, composed)) if a != b), min(len(line), len(composed)))
            yield error(1, "UNICODE", "unicode-normalization", at, f"first difference at character {i + 1}")
        if line.startswith("#"):
            if seen_other:
                yield error(1, "FORMAT", "misplaced-comment", at)
                ok = False
            continue
        if not seen_other:
            s.first, seen_other = at, True
        if line[:1].isdigit():
            seen_node = True
        elif not line.strip():
            if line:
                yield error(1, "FORMAT", "pseudo-empty-line", at)
            if at < len(s.lines):
                yield error(1, "FORMAT", "extra-empty-line", at)
                ok = False
            elif not seen_node:
                yield error(1, "FORMAT", "empty-sentence", at)
                ok = False
        else:
            yield error(1, "FORMAT", "invalid-line", at, line)
            ok = False
    if s.lines and s.lines[-1].strip():
        yield error(1, "FORMAT", "missing-empty-line", len(s.lines))
        ok = seen_node
    return ok


def columns(s: Sentence) -> Iterator[Found]:
    ok = True
    for at, line in enumerate(s.lines[s.first - 1 :], s.first):
        if not line[:1].isdigit():
            continue
        cells = line.split("\t")
        if len(cells) != 10:
            yield error(1, "FORMAT", "number-of-columns", at, f"{len(cells)} columns")
            ok = False
            continue
        ranged = "-" in cells[0]
        for i, cell in enumerate(cells):
            spaced = re.search(r"\s", cell)
            if ranged and i in (1, 2) and spaced:
                yield error(1, "FORMAT", "invalid-whitespace-mwt", at, cell)
            elif i in (0, 3, 4, 5, 6, 7, 8) and spaced:
                yield error(1, "FORMAT", "invalid-whitespace", at, cell)
            elif not cell:
                yield error(1, "FORMAT", "empty-column", at)
            else:
                if cell[0].isspace():
                    yield error(1, "FORMAT", "leading-whitespace", at, cell)
                if cell[-1].isspace():
                    yield error(1, "FORMAT", "trailing-whitespace", at, cell)
                if re.search(r"\s\s", cell):
                    yield error(1, "FORMAT", "repeated-whitespace", at, cell)
    return ok


def ids(s: Sentence) -> Iterator[Found]:
    ok = True
    rows = [(at, line.split("\t")[0]) for at, line in enumerate(s.lines, 1) if line[:1].isdigit()]
    words: list[int] = []
    spans: list[tuple[int, int, int]] = []
    word, empty = 0, 1
    for at, cell in rows:
        if WORD.fullmatch(cell):
            word, empty = int(cell), 1
            words.append(word)
            if not (spans and spans[-1][0] <= word <= spans[-1][1]):
                spans.append((word, word, at))
        elif m := RANGE.fullmatch(cell):
            empty = 1
            a, b = int(m[1]), int(m[2])
            if words and a <= words[-1]:
                yield error(1, "FORMAT", "misplaced-word-interval", at, cell)
                ok = False
            else:
                spans.append((a, b, at))
        elif m := EMPTY.fullmatch(cell):
            a, b = int(m[1]), int(m[2])
            if (a, b) != (word, empty):
                yield error(1, "FORMAT", "misplaced-empty-node", at, f"{cell} instead of {word}.{empty}")
                ok = False
            empty += 1
            if a == word and spans and a < spans[-1][0]:
                yield error(1, "FORMAT", "misplaced-empty-node", at, f"{cell} behind the range")
                ok = False
        else:
            yield error(1, "FORMAT", "invalid-word-id", at, cell)
            ok = False
    if words != list(range(1, len(words) + 1)):
        yield error(1, "FORMAT", "word-id-sequence", s.first)
        ok = False
    for a, b, at in spans:
        if b < a:
            yield error(1, "FORMAT", "reversed-word-interval", at, f"{a}-{b}")
            ok = False
        elif b > len(words):
            yield error(1, "FORMAT", "word-interval-out", at, f"{a}-{b}")
            ok = False
    return ok


def overlaps(s: Sentence) -> Iterator[Found]:
    end, ok = 0, True
    for at, line in enumerate(s.lines, 1):
        if m := RANGE.fullmatch(line.split("\t")[0]):
            if int(m[1]) <= end:
                yield error(1, "FORMAT", "overlapping-word-intervals", at, m[0])
                ok = False
            end = max(end, int(m[2]))
    return ok


# Level 2: references and tree, then the cells.


def references(s: Sentence) -> Iterator[Found]:
    known, ok = {(0, 0), *(n.id for n in s.nodes if n.kind != "range")}, True
    for n in s.nodes:
        if n.kind == "range":
            continue
        if n.kind == "word":
            if not HEAD.fullmatch(n.head):
                yield error(2, "FORMAT", "invalid-head", n, n.head)
                ok = False
            elif id_of(n.head) not in known:
                yield error(2, "SYNTAX", "unknown-head", n, n.head)
                ok = False
        if n.deps == "_":
            continue
        parts = [p.partition(":") for p in n.deps.split("|")]
        if not all(colon for _, colon, _ in parts):
            yield error(2, "FORMAT", "invalid-deps", n, n.deps)
            ok = False
            continue
        for head, _, _ in parts:
            if not ENHANCED_HEAD.fullmatch(head):
                yield error(2, "FORMAT", "invalid-ehead", n, head)
                ok = False
            elif id_of(head) not in known:
                yield error(2, "ENHANCED", "unknown-ehead", n, head)
                ok = False
    return ok


def reached(start, following: Callable) -> set:
    seen, stack = set(), [start]
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            stack += following(x)
    return seen


def tree(s: Sentence) -> Iterator[Found]:
    for n in s.tree.words[1:]:
        if n.head == n.cells[0]:
            yield error(2, "SYNTAX", "head-self-loop", n)
            return False
    if len(s.tree.root.children) > 1:
        yield error(2, "SYNTAX", "multiple-roots", s.first, ",".join(n.cells[0] for n in s.tree.root.children))
        return False
    lost = set(s.tree.words) - reached(s.tree.root, lambda n: n.children)
    if lost:
        yield error(2, "SYNTAX", "non-tree", s.first, ",".join(sorted((n.cells[0] for n in lost), key=int)))
        return False
    return True


def cells(s: Sentence) -> Iterator[Found]:
    """All level 2 rules of single nodes; returns whether features are well-formed."""
    ok = True
    for n in s.nodes:
        if n.kind == "range":
            for i, cell in enumerate(n.cells[2:9], 2):
                if cell != "_" and not (i == 5 and cell == "Typo=Yes"):
                    yield error(2, "FORMAT", "mwt-nonempty-field", n, cell)
        elif n.kind == "empty":
            for cell in n.cells[6:8]:
                if cell != "_":
                    yield error(2, "FORMAT", "empty-node-nonempty-field", n, cell)
        if n.kind != "range" and n.upos not in UPOS and not (n.kind == "empty" and n.upos == "_"):
            yield error(2, "MORPHO", "unknown-upos", n, n.upos)
        if n.xpos == "":
            yield error(2, "MORPHO", "empty-string-in-xpos", n)
        ok &= yield from feature_cell(n)
        if n.kind == "word":
            if not DEPREL.fullmatch(n.deprel):
                yield error(2, "SYNTAX", "invalid-deprel", n, n.deprel)
            elif n.universal not in RELATIONS:
                yield error(2, "SYNTAX", "unknown-udeprel", n, n.deprel)
        if n.kind != "range":
            yield from edge_cell(n)
        yield from misc_cell(n)
    return ok


def feature_cell(n: Node) -> Iterator[Found]:
    if n.feats == "_":
        return True
    parts, ok, names = n.feats.split("|"), True, set()
    if [p.lower() for p in parts] != sorted(p.lower() for p in parts):
        yield error(2, "MORPHO", "unsorted-features", n, n.feats)
    for part in parts:
        m = FEATURE.fullmatch(part)
        if not m:
            yield error(2, "MORPHO", "invalid-feature", n, part)
            name, ok = part.partition("=")[0], False
        else:
            name, values = m[1], m[2].split(",")
            if len(set(values)) < len(values):
                yield error(2, "MORPHO", "repeated-feature-value", n, part)
            if [v.lower() for v in values] != sorted(v.lower() for v in values):
                yield error(2, "MORPHO", "unsorted-feature-values", n, part)
            for v in values:
                if not VALUE.fullmatch(v):
                    yield error(2, "MORPHO", "invalid-feature-value", n, v)
        if name in names:
            yield error(2, "MORPHO", "repeated-feature", n, n.feats)
        names.add(name)
    return ok


def edge_cell(n: Node) -> Iterator[Found]:
    """Parsable edges are given: references() passed."""
    listed = n.edges
    heads = [h for h, _ in listed]
    if heads != sorted(heads):
        yield error(2, "FORMAT", "unsorted-deps", n, n.deps)
    else:
        for (h, d), (h2, d2) in zip(listed, listed[1:]):
            if h == h2 and d2 < d:
                yield error(2, "FORMAT", "unsorted-deps-2", n, n.deps)
            elif h == h2 and d == d2:
                yield error(2, "FORMAT", "repeated-deps", n, n.deps)
    if n.id in heads:
        yield error(2, "ENHANCED", "deps-self-loop", n, n.deps)
    for _, d in listed:
        if not ENHANCED_DEPREL.fullmatch(d):
            yield error(2, "ENHANCED", "invalid-edeprel", n, d)
        elif universal(d) not in RELATIONS and universal(d) != "ref":
            yield error(2, "ENHANCED", "unknown-eudeprel", n, d)


def misc_cell(n: Node) -> Iterator[Found]:
    if n.misc == "_":
        return
    counts: dict[str, int] = {}
    for part in n.misc.split("|"):
        key, equals, value = part.partition("=")
        if not key:
            yield warning(2, "FORMAT", "empty-misc-key" if equals else "empty-misc", n)
        if key != key.strip() or value != value.strip():
            yield warning(2, "FORMAT", "misc-extra-space", n, part)
        if key in MISC_NAMES:
            counts[key] = counts.get(key, 0) + 1
        elif key.strip().lower() in {x.lower() for x in MISC_NAMES}:
            yield warning(2, "FORMAT", "misc-attr-typo", n, key)
    for key, times in counts.items():
        if times > 1:
            yield error(2, "FORMAT", "repeated-misc", n, key)


def metadata(s: Sentence) -> Iterator[Found]:
    found = {k: [m for c in s.comments if (m := p.fullmatch(c))] for k, p in {"sent_id": SENT_ID, "parallel_id": PARALLEL_ID, "text": TEXT, **NEW}.items()}
    at = s.first
    say = lambda testid, message="": error(2, "METADATA", testid, at, message)
    for key in ("sent_id", "parallel_id"):
        for c in s.comments:
            if c.startswith((f"# {key}", f"#{key}")) and not {"sent_id": SENT_ID, "parallel_id": PARALLEL_ID}[key].fullmatch(c):
                yield say("invalid-sent-id" if key == "sent_id" else "invalid-parallel-id", c)
    if not found["sent_id"]:
        yield say("missing-sent-id")
    elif len(found["sent_id"]) > 1:
        yield say("multiple-sent-id")
    else:
        name = found["sent_id"][0][1]
        if name.count("/") > 1 or (s.main != "ud" and "/" in name):
            yield say("slash-in-sent-id", name)
    if len(found["parallel_id"]) > 1:
        yield say("multiple-parallel-id")
    for key in NEW:
        if len(found[key]) > 1:
            yield say(f"multiple-{key}")
    if not found["text"]:
        yield say("missing-text")
    elif len(found["text"]) > 1:
        yield say("multiple-text")
    else:
        yield from text_and_forms(s, found["text"][0][1])


def text_and_forms(s: Sentence, text: str) -> Iterator[Found]:
    if not text:
        yield error(2, "METADATA", "empty-text", s.first)
    elif text[-1].isspace():
        yield error(2, "METADATA", "text-trailing-whitespace", s.first)
    covered, mismatch = 0, False
    for n in s.nodes:
        no_space = "SpaceAfter=No" in n.misc
        if "NoSpaceAfter=Yes" in n.misc:
            yield error(2, "METADATA", "nospaceafter-yes", s.first)
        if any(p.startswith("SpaceAfter=") and p != "SpaceAfter=No" for p in n.misc.split("|")):
            yield error(2, "METADATA", "spaceafter-value", n)
        if n.kind == "empty":
            if no_space:
                yield error(2, "METADATA", "spaceafter-empty-node", n)
            continue
        if n.kind == "word" and n.id[0] <= covered:
            if no_space:
                yield error(2, "METADATA", "spaceafter-mwt-node", n)
            continue
        covered = max(covered, n.last if n.kind == "range" else 0)
        if not text.startswith(n.form):
            if not mismatch:
                yield error(2, "METADATA", "text-form-mismatch", n, f"{n.form} / {text[:20]}")
            mismatch = True
            continue
        text = text[len(n.form) :]
        if "SpaceAfter=No" not in n.misc.split("|"):
            if text and not text[0].isspace():
                yield error(2, "METADATA", "missing-spaceafter", n)
            text = text.lstrip()
    if text:
        yield error(2, "METADATA", "text-extra-chars", s.first, text)


def graph_connected(s: Sentence) -> Iterator[Found]:
    out: dict[tuple[int, int], list] = {}
    for n in s.tree.enhanced:
        for h, _ in n.edges:
            out.setdefault(h, []).append(n.id)
    if out:
        lost = {n.id for n in s.tree.enhanced if n.deps != "_"} - reached((0, 0), lambda i: out.get(i, []))
        if lost:
            yield error(2, "ENHANCED", "unconnected-egraph", s.first, ",".join(map(id_text, sorted(lost))))


# Level 3: universal content.

# Tags that a relation asks for, or rules out.
ASKED = {"det": ("DET", "PRON"), "nummod": ("NUM", "NOUN", "SYM"), "advmod": ("ADV", "ADJ", "CCONJ", "DET", "PART", "SYM"), "expl": ("PRON", "DET", "PART"), "aux": ("AUX",), "cop": ("AUX", "PRON", "DET", "SYM"), "punct": ("PUNCT",)}
RULED_OUT = {
    "case": ("PROPN", "ADJ", "PRON", "DET", "NUM", "AUX"),
    "mark": ("NOUN", "PROPN", "ADJ", "PRON", "DET", "NUM", "AUX", "INTJ"),
    "cc": ("NOUN", "PROPN", "ADJ", "PRON", "DET", "NUM", "VERB", "AUX", "INTJ"),
}
# Relations that functional words may govern, and the test of the others.
_MARKED = {"advmod", "obl", "goeswith", "fixed", "reparandum", "conj", "cc", "punct"}
_HELPING = {"goeswith", "fixed", "reparandum", "conj", "cc", "punct"}
LEAVES: dict[str, tuple[str, set[str]]] = {
    "mark": ("leaf-mark-case", _MARKED), "case": ("leaf-mark-case", _MARKED), "aux": ("leaf-aux-cop", _HELPING), "cop": ("leaf-aux-cop", _HELPING),
    "det": ("leaf-det", {"det", "case", "advmod", "obl", "clf", "goeswith", "fixed", "flat", "compound", "reparandum", "discourse", "parataxis", "conj", "cc", "punct"}),
    "clf": ("leaf-clf", _MARKED), "cc": ("leaf-cc", {"goeswith", "fixed", "reparandum", "conj", "punct"}),
    "fixed": ("leaf-fixed", {"goeswith", "reparandum", "conj", "punct"}), "goeswith": ("leaf-goeswith", set()), "punct": ("leaf-punct", {"punct"}),
}
#: Relations that ask for the whole tag; the others for its beginning.
WHOLE = ("nummod", "expl", "punct")
ORPHAN_PARENTS = {"conj", "parataxis", "root", "csubj", "ccomp", "advcl", "acl", "reparandum"}
NOMINAL_RELATIONS = {"nsubj", "obj", "iobj", "obl", "vocative", "dislocated", "expl", "nmod"}
#: The rules on words, parents and children as rules on columns.
CONTENT = by_columns.rules(ASKED, RULED_OUT, LEAVES, NOMINAL_RELATIONS, WHOLE)
#: Tests that need no walk at any level.
COLUMNAR = {"head-self-loop", "missing-text", *(t for t in CONTENT if not t.startswith("leaf-"))}


def descendants(n: Node) -> set[Node]:
    return reached(n, lambda x: x.children) - {n}


def gap(s: Sentence, n: Node) -> list[Node]:
    """Words between n and its parent that the parent does not dominate."""
    a, b = sorted((n.id[0], n.parent.id[0]))
    between = s.tree.words[a + 1 : b]
    if not between:
        return []
    below = descendants(n.parent)
    return [x for x in between if x not in below]


def crossed_by(s: Sentence, n: Node) -> list[Node]:
    """Words whose edge crosses that between n and its parent at n: it passes over n, not over the parent, and does not hang on an ancestor of n."""
    above, x = set(), n.parent
    while x is not None:
        above.add(x)
        x = x.parent
    at, up = n.id[0], n.parent.id[0]
    out = []
    for w in s.tree.words[1:]:
        low, high = sorted((w.id[0], w.parent.id[0]))
        if low < at < high and not low <= up <= high and w.parent not in above:
            out.append(w)
    return out


def content(s: Sentence) -> Iterator[Found]:
    for n in s.tree.words[1:]:
        yield from of_word(s, n)
    for n in s.tree.enhanced:
        for h, d in n.edges:
            if h == (0, 0) and universal(d) != "root":
                yield error(3, "ENHANCED", "enhanced-0-is-not-root", n, d)
            elif h != (0, 0) and universal(d) == "root":
                yield error(3, "ENHANCED", "enhanced-root-is-not-0", n, d)


def of_word(s: Sentence, n: Node) -> Iterator[Found]:
    feats, rel, parent = n.features, n.universal, n.parent
    below = {c.universal for c in n.children}
    say = lambda testid, at=n, testclass="SYNTAX", kind=error: kind(3, testclass, testid, at, f"{at.form} {at.upos} {at.deprel}")
    if n.upos in ("PRON", "DET") and "PronType" not in feats:
        yield say("pron-det-without-prontype", n, "MORPHO", warning)
    if feats.get("VerbForm") == "Fin" and "Mood" not in feats:
        yield say("verbform-fin-without-mood", n, "MORPHO", warning)
    if (n.head == "0") != (rel == "root"):
        yield say("0-is-not-root" if n.head == "0" else "root-is-not-0")
    upos = feats.get("ExtPos") or n.upos
    if "fixed" in below and not feats.get("ExtPos"):
        yield say("fixed-without-extpos", n, "SYNTAX", warning)
    prefixed = rel in WHOLE  # these ask for the whole tag, the others for its beginning
    if rel in ASKED and not (upos in ASKED[rel] if prefixed else upos.startswith(ASKED[rel])) and not (rel == "advmod" and "goeswith" in below):
        yield say(f"rel-upos-{rel}")
    if rel in RULED_OUT and upos.startswith(RULED_OUT[rel]):
        yield say(f"rel-upos-{rel}")
    if upos == "PUNCT" and not rel.startswith(("punct", "root")):
        yield say("upos-rel-punct")
    if upos == "PROPN" and (rel == "fixed" or "fixed" in below):
        yield say("rel-upos-fixed")
    if n.deprel == "flat:foreign":
        for x in (n, parent):
            if x.upos != "X" or x.feats != "Foreign=Yes":
                yield say("flat-foreign-upos-feats", x, "MORPHO", warning)
    if rel in ("conj", "fixed", "flat", "goeswith", "appos") and n.id < parent.id:
        yield say(f"right-to-left-{rel}")
    subjects = [c for c in n.children if "subj" in c.universal and c.deprel not in ("nsubj:outer", "csubj:outer") and c.attributes.get("Subject") != "Outer"]
    if len(subjects) > 1:
        yield say("too-many-subjects")
    if sum(c.universal == "obj" for c in n.children) > 1:
        yield say("too-many-objects")
    if rel == "obl" and parent.upos in ("NOUN", "PROPN", "PRON") and parent.universal in NOMINAL_RELATIONS and not {"cop", "nsubj", "csubj"} & {c.universal for c in parent.children}:
        yield say("obl-should-be-nmod")
    if rel == "orphan" and parent.universal not in ORPHAN_PARENTS:
        yield say("orphan-parent", parent if parent.line else n, "SYNTAX", warning)
    if rel in LEAVES:
        testid, allowed = LEAVES[rel]
        crossing = None
        for c in n.children:
            if rel != "punct" and c.universal == "advmod" and c.upos in ("PART", "ADV") and c.features.get("Polarity") == "Neg":
                continue
            if c.universal == "punct" and rel != "punct":
                crossing = bool(gap(s, n)) if crossing is None else crossing
                if crossing:
                    continue
            more = {"appos", "acl", "nmod"} if rel == "det" and feats.get("Poss") == "Yes" else set()
            if c.universal not in allowed | more:
                yield say(testid, c)
    for kind in ("fixed", "goeswith"):
        group = [c for c in n.children if c.universal == kind]
        if not group:
            continue
        span = s.tree.words[n.id[0] : group[-1].id[0] + 1]
        if kind == "fixed":
            if any(x is not n and x not in group and x.universal != "punct" for x in span):
                yield say("fixed-gap", n, "SYNTAX", warning)
            continue
        if sorted([n, *group], key=lambda x: x.id) != span:
            yield say("goeswith-gap")
        if any(x.attributes.get("SpaceAfter") == "No" for x in sorted([n, *group], key=lambda x: x.id)[:-1]):
            yield say("goeswith-nospace")
        if feats.get("Typo") != "Yes":
            yield say("goeswith-missing-typo", n, "MORPHO")
    if rel == "goeswith":
        for cell, right, testid in ((n.lemma, "_", "goeswith-lemma"), (n.upos, "X", "goeswith-upos"), (n.feats, "_", "goeswith-feats")):
            if cell != right:
                yield say(testid, n, "MORPHO")
        if n.deps not in ("_", f"{n.head}:{n.deprel}"):
            yield say("goeswith-edeps", n, "ENHANCED")
    if rel == "punct":
        if crossed_by(s, n):
            yield say("punct-causes-nonproj")
        if gap(s, n):
            yield say("punct-is-nonproj")


# Levels 4 and 5: against the registry. An unknown language has an empty one.


def of_language(s: Sentence, level: int) -> Iterator[Found]:
    main = s.registry.get(s.main, Language(relations=frozenset()))
    by_id = {n.id: n for n in s.tree.enhanced}
    ranges = [n for n in s.nodes if n.kind == "range"]
    for n in s.tree.enhanced:
        name = n.attributes.get("Lang") or s.main
        own = s.registry.get(name, Language(relations=frozenset()))
        for word in (n.form, n.lemma):
            if re.search(r"\s", word) and not own.with_space(word):
                yield error(4, "FORMAT", "invalid-word-with-space", n, word)
        for f, values in n.features.items():
            lang = main if f == "Foreign" else own
            for v in values.split(","):
                if f == "Typo" and any(r.id[0] <= n.id[0] <= r.last and r.features.get("Typo") == "Yes" for r in ranges):
                    yield error(4, "MORPHO", "mwt-typo-repeated-at-word", n)
                if f in lang.banned:
                    testid = "feature-not-permitted"
                elif f not in lang.features:
                    testid = "feature-unknown"
                elif v not in lang.values(f):
                    testid = "feature-value-unknown"
                elif n.upos not in lang.features[f]:
                    testid = "feature-upos-not-permitted"
                elif v not in lang.features[f][n.upos]:
                    testid = "feature-value-upos-not-permitted"
                else:
                    continue
                yield error(4, "MORPHO", testid, n, f"{f}={v}")
        other = lambda p: p is not None and name != s.main and (p.attributes.get("Lang") or s.main) == name  # noqa: B023, E731
        if n.kind == "word" and n.deprel not in main.relations and not (other(n.parent) and n.deprel in own.relations):
            yield error(4, "SYNTAX", "unknown-deprel", n, n.deprel)
        for h, d in n.edges:
            if not main.enhanced(d) and not (other(by_id.get(h)) and own.enhanced(d)):
                yield error(4, "ENHANCED", "unknown-edeprel", n, d)
        if level >= 5:
            if n.upos == "AUX" and n.lemma not in own.auxiliaries:
                yield error(5, "MORPHO", "aux-lemma", n, n.lemma)
            if n.kind == "word" and n.universal == "cop" and n.lemma not in own.copulas:
                yield error(5, "MORPHO", "cop-lemma", n, n.lemma)


#: Checks of a user: level and a function from the sentence to findings; see `register`.
EXTRA: dict[str, tuple[int, Callable[[Sentence], Iterator[Found]]]] = {}


def register(name: str, level: int, check: Callable[[Sentence], Iterator[Found]]) -> None:
    """Adds a check that runs on every sentence whose tree is sound."""
    EXTRA[name] = (level, check)


def chain(raw: str, language: str, level: int, registry: dict[str, Language], extra=()) -> Iterator[Found]:
    """All findings of one sentence; the last one, of type FACT, says what passed."""
    s = Sentence(raw, language, registry, language if level >= 4 else "ud", raw.split("\n"))
    for check in (backbone, columns, ids, overlaps):
        if not (yield from check(s)):
            return
    s.comments = [x for x in s.lines[: s.first - 1] if x.startswith("#")]
    s.tree = Tree(raw)
    if level < 2:
        return
    if not (yield from references(s)):
        return
    if not (yield from tree(s)):
        return
    if not (yield from cells(s)):
        return
    yield from metadata(s)
    yield from graph_connected(s)
    if level >= 3:
        yield from content(s)
    if level >= 4:
        yield from of_language(s, level)
    for at_level, check in extra:
        if level >= at_level:
            yield from check(s)
    yield Found(0, "FACT", "", "", s.first, "", "")


def validate(sentences: DataFrame, keys: tuple[str, ...], language: str = "lang", level: int = 5, registry: dict[str, Language] = SAMPLE, *, warnings: bool = True, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), whole: bool = True) -> DataFrame:
    """Incidents of sentences (keys, raw with its blank last line, `language`), of each sentence alone.

    Findings that a treebank without features delays for good are filtered by `delayed`, and those between
    sentences come from `across`; `whole` adds the blank line that the reader has cut off.
    """
    extra = list(EXTRA.values())

    rows = sentences.select(*keys, "raw", F.col(language).alias("_lang"))

    def kept(kind: str, testid: str) -> bool:
        return kind == "FACT" or not ((kind == "WARNING" and not warnings) or testid in exclude or (include and testid not in include))

    def step(raw: str, lang: str) -> Iterator[Found]:
        for f in chain(raw + "\n" if whole else raw, lang, level, registry, extra):
            if kept(f.type, f.testid):
                yield f

    if level >= 2 and not extra and (level <= 3 or (include and set(include) <= COLUMNAR)):
        return _validated(rows, keys, step, kept, set(include) - set(exclude) if include else None, level, whole)
    return per_sentence(rows, keys, step, INCIDENT)


def _well_formed(feats: str) -> bool:
    return feats == "_" or all(FEATURE.fullmatch(p) for p in feats.split("|"))


def _validated(rows: DataFrame, keys: tuple[str, ...], walk: Callable[..., Iterator[Found]], kept: Callable[[str, str], bool], asked: set[str] | None, level: int, ended: bool) -> DataFrame:
    """The incidents of `asked` (all, if None) for a batch of sentences at once; only sentences in odd spelling, or with what is rare, are walked."""
    from arborlake.operators import plain  # it asks the rules above

    out_type = StructType([*(rows.schema[k] for k in keys), *_parse_datatype_string(INCIDENT).fields])
    arrow = to_arrow_schema(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_ in batches:
            for a, b in by_columns.batches(all_.column("raw"), SLICE):
                batch = all_.slice(a, b - a)
                judged = plain.Plain(batch.column("raw").cast(pa.string()), ended, asked)
                told, found = judged.found(level)
                at = np.flatnonzero(judged.walked)
                texts, langs = (batch.column(c).take(pa.array(at)).to_pylist() for c in ("raw", "_lang"))
                found = [f for f in found if kept(f[2], f[4])] + [(i, *f) for i, raw, lang in zip(at.tolist(), texts, langs) for f in walk(raw, lang)]
                of, made = plain.arrays(plain.filtered(told, kept), found, [arrow[k].type for k in range(len(keys), len(arrow))])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in keys), *made], names=arrow.names)

    return rows.mapInArrow(run, out_type)


def incidents(found: DataFrame) -> DataFrame:
    return found.where("type <> 'FACT'")


DELAYED = ("pron-det-without-prontype", "goeswith-missing-typo")


def delayed(found: DataFrame, sentences: DataFrame, treebank: str) -> DataFrame:
    """Drops the findings that ask for features where the whole treebank has none. `sentences` have `lines`: their nodes' lines."""
    return featured(found, sentences.groupBy(treebank).agg(F.max(F.exists("lines", lambda x: F.coalesce(F.get(F.split(x, "\t"), F.lit(5)), F.lit("_")) != "_").cast("int")).alias("_featured")), treebank)


def featured(found: DataFrame, treebanks: DataFrame, treebank: str) -> DataFrame:
    """delayed(), with a row for each treebank: whether it is `_featured`."""
    return found.join(treebanks, treebank).where(F.col("_featured").eqNullSafe(1) | ~F.col("testid").isin(*DELAYED)).drop("_featured")


def _at(rows: DataFrame, keys: tuple[str, ...], level: int, testclass: str, testid: Column | str, node: Column | None = None) -> DataFrame:
    name = F.lit(testid) if isinstance(testid, str) else testid
    return rows.select(*keys, F.lit(level).alias("level"), F.lit("ERROR").alias("type"), F.lit(testclass).alias("testclass"), name.alias("testid"), F.lit(1).alias("line"), (F.lit("") if node is None else node).alias("node"), F.lit("").alias("message"))


def facts_of(raw: str) -> tuple:
    """What the checks between sentences need of a sentence that passed its own."""
    t = Tree(raw)
    named = lambda p: next((m[1] for c in t.comments if (m := p.fullmatch(c))), "")
    surface = [n for n in t.nodes if n.kind != "empty"]
    until = max((n.last for n in surface if n.kind == "range"), default=0)
    last = next((n for n in surface if n.kind == "range" and n.last == surface[-1].id[0]), surface[-1]) if until >= surface[-1].id[0] else surface[-1]
    enhanced = [n for n in t.enhanced if n.deps != "_"]
    return (
        named(SENT_ID), named(PARALLEL_ID), any(p.fullmatch(c) for c in t.comments for p in NEW.values()), "SpaceAfter=No" in last.misc.split("|"),
        bool(enhanced), any(n.deps != f"{n.head}:{n.deprel}" for n in enhanced), [n.cells[0] for n in enhanced if n.kind == "empty"],
        [n.cells[0] for n in enhanced if any(universal(d) == "orphan" for _, d in n.edges)],
    )


FACTS = "sent_id string, parallel_id string, begins boolean, ends_glued boolean, enhanced boolean, differs boolean, empties array<string>, orphans array<string>"


def facts(sentences: DataFrame, keys: tuple[str, ...], whole: bool = True) -> DataFrame:
    """A narrow row for each sentence (keys, raw) that passes levels 1 and 2; written, as several checks read it."""
    return written(passing(sentences, keys, whole), "facts")


def passing(sentences: DataFrame, keys: tuple[str, ...], whole: bool = True) -> DataFrame:
    """The rows of facts(); also of a stream. Only sentences in odd spelling are walked."""
    from arborlake.operators import plain

    out_type = StructType([*(sentences.schema[k] for k in keys), *_parse_datatype_string(FACTS).fields])
    types = [to_arrow_schema(out_type)[k].type for k in range(len(keys), len(out_type))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_ in batches:
            for a, b in by_columns.batches(all_.column("raw"), SLICE):
                batch = all_.slice(a, b - a)
                judged = plain.Plain(batch.column("raw").cast(pa.string()), whole, set())
                of, columns = judged.facts()
                odd = [(i, *facts_of(raw)) for i, raw in judged.texts(judged.odd, whole) if any(f.type == "FACT" for f in chain(raw, "ud", 2, {}))]
                of, made = plain.arrays([(of, *columns)], odd, types)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in keys), *made], names=out_type.names)

    return sentences.select(*keys, "raw").mapInArrow(run, out_type)


def across(facts: DataFrame, keys: tuple[str, ...], treebank: str, file: str) -> DataFrame:
    """Incidents between sentences, from their facts.

    The order of sentences is that of the keys. Windows are over (treebank, id) or over a task's stretch of a file, of narrow rows.
    """
    facts = facts.withColumn("place", F.struct(*keys))
    again = F.row_number().over(W.partitionBy(treebank, "sent_id").orderBy("place"))
    repeated = _at(facts.where("sent_id <> ''").withColumn("_nth", again).where("_nth > 1"), keys, 2, "METADATA", "non-unique-sent-id")
    breaks = _at(_after_glued(facts, keys, file).where("begins"), keys, 2, "METADATA", "spaceafter-newdocpar")
    kinds = facts.groupBy(treebank, "enhanced").agg(F.min("place").alias("place"))
    second = kinds.groupBy(treebank).agg(F.max("place").alias("place"), F.count("*").alias("n")).where("n > 1")
    sometimes = _at(second.select(treebank, "place.*", "place") if treebank not in keys else second.select("place.*"), keys, 2, "ENHANCED", "edeps-only-sometimes")
    whole = facts.groupBy(treebank).agg(F.max(F.col("enhanced").cast("int")).alias("any"), F.max(F.coalesce(F.col("differs"), F.lit(False)).cast("int")).alias("differs"), F.max("place").alias("last")).where("any = 1 and differs = 0")
    same = _at(whole.select("last.*"), keys, 3, "ENHANCED", "edeps-identical-to-basic-trees")
    empty = facts.where("size(empties) > 0").groupBy(treebank).agg(F.min(F.struct("place", F.get("empties", F.lit(0)).alias("id"))).alias("empty"))
    orphan = facts.where("size(orphans) > 0").groupBy(treebank).agg(F.min("place").alias("orphan"))
    late = empty.join(orphan, treebank).where("orphan < empty.place")
    after = _at(late.select("empty.place.*", F.col("empty.id").alias("_node")), keys, 3, "ENHANCED", "empty-node-after-eorphan", F.col("_node"))
    # A row for each treebank; only sentences with orphans meet it.
    orphans = facts.where("size(orphans) > 0").join(empty, treebank).where("place > empty.place").select(*keys, F.explode("orphans").alias("_node"))
    before = _at(orphans, keys, 3, "ENHANCED", "eorphan-after-empty-node", F.col("_node"))
    parallel = _parallel(facts.where("parallel_id <> ''"), keys, treebank)
    out = repeated
    for more in (breaks, sometimes, same, after, before, parallel):
        out = out.unionByName(more)
    return out


def _after_glued(facts: DataFrame, keys: tuple[str, ...], file: str) -> DataFrame:
    """keys, begins: sentences after one of the same file that ends without a space.

    Sentences are dealt by ranges in order, and written, so that a stretch of a file is in one task; its first sentence
    follows the last one of the stretch before. A file is in no single task.
    """
    names = list(dict.fromkeys([*keys, file]))
    dealt = written(facts.select(*names, "place", "begins", "ends_glued").repartitionByRange(file, "place").withColumn("_part", F.spark_partition_id()), "in_order")
    ends = dealt.groupBy("_part", F.col(file).alias("_file")).agg(F.max_by("ends_glued", "place").alias("last"))
    ends = ends.withColumn("_carried", F.lag("last").over(W.partitionBy("_file").orderBy("_part"))).withColumnRenamed("_part", "_in").drop("last")  # a row for each stretch
    inside = W.partitionBy("_part", file).orderBy("place")
    rows = dealt.withColumns({"_nth": F.row_number().over(inside), "_before": F.lag("ends_glued").over(inside)})
    met = rows.join(F.broadcast(ends), (rows["_part"] == ends["_in"]) & rows[file].eqNullSafe(ends["_file"]), "left")
    return met.where(F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col("_before"))).select(*keys, "begins")


def _parallel(facts: DataFrame, keys: tuple[str, ...], treebank: str) -> DataFrame:
    """Whole ids must be unique; numbers of alternatives and parts of a sentence run 1, 2, 3 or are absent from all."""
    number = lambda kind: F.nullif(F.regexp_extract("parallel_id", rf"{kind}([0-9]+)", 1), F.lit("")).cast("int")
    rows = facts.withColumns({"core": F.regexp_extract("parallel_id", r"\A[^/]+/[^/]+", 0), "alt": number("/alt"), "part": number("part")})
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy(treebank, "parallel_id").orderBy("place")))
    out = _at(rows.where("_nth > 1"), keys, 2, "METADATA", "non-unique-parallel-id")
    order = W.partitionBy(treebank, "core").orderBy("place")
    first = rows.where("_nth = 1").withColumn("at", F.row_number().over(order))
    for kind in ("alt", "part"):
        before = F.lag(kind).over(order)
        wrong = F.when(F.col("at") == 1, F.coalesce(F.col(kind), F.lit(1)) != 1).otherwise(~(before + 1).eqNullSafe(F.col(kind)))
        out = out.unionByName(_at(first.withColumn("wrong", wrong).where("wrong"), keys, 2, "METADATA", f"parallel-id-{kind}"))
    return out


def newlines(files: DataFrame) -> DataFrame:
    """Files (file, value: the whole text) with other line ends than a line feed."""
    return files.where(F.col("value").contains("\r")).select("file", F.lit(1).alias("level"), F.lit("ERROR").alias("type"), F.lit("FORMAT").alias("testclass"), F.lit("non-unix-newline").alias("testid"))


# The report.


def capped(found: DataFrame, k: int = 20, order: tuple[str, ...] = (), by: tuple[str, ...] = ("type", "testclass")) -> DataFrame:
    """The first k incidents of each type and class: the report's cap is the feature. A task hands on k of a group at most (WindowGroupLimit)."""
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order, "line", "node", "testid"))).where(F.col("rank") <= k)


def summary(found: DataFrame, *keys: str) -> DataFrame:
    """Counts by type, class and test."""
    return found.groupBy(*keys, "type", "testclass", "testid").agg(F.count("*").alias("n"))


def passed(found: DataFrame, treebanks: DataFrame, treebank: str) -> DataFrame:
    """PASSED or FAILED for each treebank; warnings do not fail it."""
    errors = found.where("type = 'ERROR'").groupBy(treebank).agg(F.count("*").alias("n_errors"))
    return treebanks.select(treebank).distinct().join(errors, treebank, "left").select(treebank, F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.when(F.col("n_errors") > 0, "FAILED").otherwise("PASSED").alias("verdict"))


def as_json(found: DataFrame) -> DataFrame:
    return found.select(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in found.columns))).alias("json"))


def as_text(found: DataFrame) -> DataFrame:
    return found.select(F.format_string("[Line %d Node %s]: [L%d %s %s] %s", "line", "node", "level", "testclass", "testid", "message").alias("line"))
