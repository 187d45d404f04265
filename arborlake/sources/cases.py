"""Small sentences with one planted defect each, and the findings that they must have: the validator's ground truth.

The base sentence is valid at every level. A case edits cells, comments or lines of it, and lists every test
id that must be found (once for each time), including what follows from the defect elsewhere.
"""

from __future__ import annotations

from typing import NamedTuple

BASE = [
    "1\tShe\tshe\tPRON\t_\tCase=Nom|Number=Sing|PronType=Prs\t2\tnsubj\t2:nsubj\t_",
    "2\treads\tread\tVERB\t_\tMood=Ind|Number=Sing|VerbForm=Fin\t0\troot\t0:root\t_",
    "3\tthe\tthe\tDET\t_\tPronType=Art\t4\tdet\t4:det\t_",
    "4\tbook\tbook\tNOUN\t_\tCase=Acc|Number=Sing\t2\tobj\t2:obj\tSpaceAfter=No",
    "5\t.\t.\tPUNCT\t_\t_\t2\tpunct\t2:punct\t_",
]
TEXT = "# text = She reads the book."
_COLUMNS = {c: i for i, c in enumerate(("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"))}


class Case(NamedTuple):
    level: int
    raw: str
    found: tuple[str, ...]


def _rows(*edits: tuple[int, str, str]) -> list[str]:
    rows = [r.split("\t") for r in BASE]
    for line, column, value in edits:
        rows[line - 1][_COLUMNS[column]] = value
    return ["\t".join(r) for r in rows]


def _raw(rows: list[str], comments: tuple[str, ...] = ("# sent_id = {id}", TEXT)) -> str:
    return "\n".join([*comments, *rows])


def _edit(level: int, found: str, *edits: tuple[int, str, str]) -> Case:
    return Case(level, _raw(_rows(*edits)), tuple(found.split()))


def _with(level: int, found: str, *, comments: tuple[str, ...] | None = None, rows: list[str] | None = None) -> Case:
    return Case(level, _raw(rows or list(BASE), comments if comments is not None else ("# sent_id = {id}", TEXT)), tuple(found.split()))


def _goes(head: str, second: str, misc: str = "_") -> list[str]:
    """Word 4 in two parts."""
    return [*BASE[:3], f"4\tbo\tbook\tNOUN\t_\t{head}\t2\tobj\t2:obj\t{misc}", second, "6\t.\t.\tPUNCT\t_\t_\t2\tpunct\t2:punct\t_"]


_SPLIT_TEXT = ("# sent_id = {id}", "# text = She reads the bo ok .")
_RANGE = "3-4\tthe book\t_\t_\t_\t_\t_\t_\t_\tSpaceAfter=No"
_EMPTY = "2.1\tgone\tgo\tVERB\t_\t_\t_\t_\t2:conj\t_"

CASES: list[Case] = [
    _with(0, ""),
    # Level 1
    _with(1, "misplaced-comment", rows=[*BASE[:2], "# late", *BASE[2:]]),
    _with(1, "invalid-line", rows=[*BASE[:2], "x", *BASE[2:]]),
    _with(1, "empty-sentence", rows=["# only comments"]),
    _with(1, "number-of-columns", rows=["1\tShe\tshe", *BASE[1:]]),
    _with(1, "unicode-normalization text-form-mismatch text-extra-chars", rows=_rows((4, "form", "boo\u0301k"))),
    _edit(1, "invalid-whitespace", (4, "xpos", "a b")),
    _edit(1, "empty-column empty-string-in-xpos", (4, "xpos", "")),
    _edit(1, "leading-whitespace", (4, "lemma", " book")),
    _edit(1, "trailing-whitespace", (4, "lemma", "book ")),
    _edit(1, "repeated-whitespace", (4, "lemma", "bo  ok")),
    _with(1, "invalid-whitespace-mwt", rows=[*BASE[:2], _RANGE, *_rows((4, "misc", "_"))[2:]]),
    _edit(1, "invalid-word-id word-id-sequence word-interval-out", (4, "id", "04")),
    _edit(1, "word-id-sequence word-interval-out", (5, "id", "6")),
    _with(1, "misplaced-word-interval", rows=[*BASE[:4], _RANGE.replace("the book", "thebook"), BASE[4]]),
    _with(1, "misplaced-empty-node", rows=[*BASE[:3], _EMPTY, *BASE[3:]]),
    _with(1, "reversed-word-interval", rows=[*BASE[:2], "4-3" + _RANGE[3:].replace("the book", "thebook"), *BASE[2:]]),
    _with(1, "word-interval-out", rows=[*BASE[:4], "5-9\t.\t_\t_\t_\t_\t_\t_\t_\t_", BASE[4]]),
    _with(1, "overlapping-word-intervals", rows=[*BASE[:1], "2-3\treads\t_\t_\t_\t_\t_\t_\t_\t_", BASE[1], "3-4\tthe\t_\t_\t_\t_\t_\t_\t_\t_", *BASE[2:]]),
    # Level 2: references and trees
    _edit(2, "invalid-head", (4, "head", "-2")),
    _edit(2, "unknown-head", (4, "head", "9")),
    _edit(2, "invalid-deps", (4, "deps", "2obj")),
    _edit(2, "invalid-ehead", (4, "deps", "02:obj")),
    _edit(2, "unknown-ehead", (4, "deps", "7:obj")),
    _edit(2, "head-self-loop", (4, "head", "4")),
    _edit(2, "multiple-roots", (4, "head", "0")),
    _edit(2, "non-tree", (4, "head", "3")),
    # Level 2: cells
    _with(2, "mwt-nonempty-field", rows=[*BASE[:2], "3-4\tthebook\tx\t_\t_\t_\t_\t_\t_\tSpaceAfter=No", *_rows((4, "misc", "_"))[2:]], comments=("# sent_id = {id}", "# text = She reads thebook.")),
    _with(2, "empty-node-nonempty-field", rows=[*BASE[:2], _EMPTY.replace("_\t_\t2:conj", "2\t_\t2:conj"), *BASE[2:]]),
    _edit(2, "unknown-upos", (4, "upos", "NOUNS")),
    _edit(2, "unsorted-features", (4, "feats", "Number=Sing|Case=Acc")),
    _edit(2, "invalid-feature", (4, "feats", "case=Acc")),
    _edit(2, "repeated-feature-value", (4, "feats", "Case=Acc,Acc")),
    _edit(2, "unsorted-feature-values", (4, "feats", "Case=Nom,Acc")),
    _edit(2, "repeated-feature", (4, "feats", "Case=Acc|Case=Nom")),
    _edit(2, "invalid-deprel", (4, "deprel", "Obj")),
    _edit(2, "unknown-udeprel", (4, "deprel", "object")),
    _edit(2, "unsorted-deps", (4, "deps", "5:conj|2:obj")),
    _edit(2, "unsorted-deps-2", (4, "deps", "2:obj|2:conj")),
    _edit(2, "repeated-deps", (4, "deps", "2:obj|2:obj")),
    _edit(2, "deps-self-loop", (4, "deps", "2:obj|4:conj")),
    _edit(2, "invalid-edeprel", (4, "deps", "2:obj:A")),
    _edit(2, "unknown-eudeprel", (4, "deps", "2:object")),
    _edit(2, "empty-misc", (3, "misc", "A=b|")),
    _edit(2, "empty-misc-key", (3, "misc", "=b")),
    _edit(2, "misc-extra-space", (3, "misc", "A =b")),
    _edit(2, "misc-attr-typo", (3, "misc", "gloss=b")),
    _edit(2, "repeated-misc", (3, "misc", "Gloss=a|Gloss=b")),
    _edit(2, "unconnected-egraph", (4, "deps", "3:obj")),
    # Level 2: metadata
    _with(2, "missing-sent-id", comments=(TEXT,)),
    _with(2, "multiple-sent-id", comments=("# sent_id = {id}", "# sent_id = {id}b", TEXT)),
    _with(2, "invalid-sent-id missing-sent-id", comments=("# sent_id =", TEXT)),
    _with(2, "slash-in-sent-id", comments=("# sent_id = a/{id}/b", TEXT)),
    _with(2, "invalid-parallel-id", comments=("# sent_id = {id}", "# parallel_id = UP", TEXT)),
    _with(2, "multiple-parallel-id", comments=("# sent_id = {id}", "# parallel_id = up/1", "# parallel_id = up/2", TEXT)),
    _with(2, "multiple-newdoc", comments=("# newdoc", "# newdoc id = x", "# sent_id = {id}", TEXT)),
    _with(2, "multiple-newpar", comments=("# newpar", "# newpar", "# sent_id = {id}", TEXT)),
    _with(2, "missing-text", comments=("# sent_id = {id}",)),
    _with(2, "multiple-text", comments=("# sent_id = {id}", TEXT, TEXT)),
    _with(2, "empty-text text-form-mismatch", comments=("# sent_id = {id}", "# text = ")),
    _with(2, "text-trailing-whitespace", comments=("# sent_id = {id}", TEXT + " ")),
    _edit(2, "nospaceafter-yes", (3, "misc", "NoSpaceAfter=Yes")),
    _edit(2, "spaceafter-value", (3, "misc", "SpaceAfter=Yes")),
    _with(2, "spaceafter-empty-node", rows=[*BASE[:2], _EMPTY[:-1] + "SpaceAfter=No", *BASE[2:]]),
    _with(2, "spaceafter-mwt-node", rows=[*BASE[:2], "3-4\tthebook\t_\t_\t_\t_\t_\t_\t_\tSpaceAfter=No", *BASE[2:]], comments=("# sent_id = {id}", "# text = She reads thebook.")),
    _edit(2, "text-form-mismatch text-extra-chars", (5, "form", "!")),
    _edit(2, "missing-spaceafter", (4, "misc", "_")),
    _with(2, "text-extra-chars", comments=("# sent_id = {id}", TEXT + " More")),
    # Level 3
    _edit(3, "pron-det-without-prontype", (3, "feats", "_")),
    _edit(3, "verbform-fin-without-mood", (2, "feats", "VerbForm=Fin")),
    _edit(3, "0-is-not-root", (2, "deprel", "obj")),
    _edit(3, "root-is-not-0", (4, "deprel", "root")),
    _edit(3, "enhanced-0-is-not-root", (2, "deps", "0:obj")),
    _edit(3, "enhanced-root-is-not-0", (4, "deps", "2:root")),
    _edit(3, "rel-upos-det", (3, "upos", "ADP"), (3, "feats", "_")),
    _edit(3, "rel-upos-nummod", (3, "deprel", "nummod")),
    _edit(3, "rel-upos-advmod", (3, "deprel", "advmod"), (3, "upos", "NOUN")),
    _edit(3, "rel-upos-expl", (3, "deprel", "expl"), (3, "upos", "NOUN")),
    _edit(3, "rel-upos-aux", (3, "deprel", "aux")),
    _edit(3, "rel-upos-cop", (3, "deprel", "cop"), (3, "upos", "ADJ")),
    _edit(3, "rel-upos-case", (3, "deprel", "case")),
    _edit(3, "rel-upos-mark", (3, "deprel", "mark")),
    _edit(3, "rel-upos-cc", (3, "deprel", "cc")),
    _edit(3, "rel-upos-punct", (3, "deprel", "punct")),
    _edit(3, "upos-rel-punct", (5, "deprel", "dep")),
    _edit(3, "fixed-without-extpos", (5, "deprel", "fixed"), (5, "upos", "ADV"), (5, "head", "4")),
    _edit(3, "rel-upos-fixed", (5, "deprel", "fixed"), (5, "upos", "PROPN"), (5, "head", "4"), (4, "feats", "ExtPos=ADV")),
    _edit(3, "flat-foreign-upos-feats flat-foreign-upos-feats", (5, "deprel", "flat:foreign"), (5, "upos", "NOUN"), (5, "head", "4")),
    _edit(3, "right-to-left-conj", (3, "deprel", "conj")),
    _edit(3, "right-to-left-appos", (3, "deprel", "appos")),
    _edit(3, "right-to-left-flat", (3, "deprel", "flat")),
    _edit(3, "too-many-subjects", (4, "deprel", "csubj")),
    _edit(3, "too-many-objects", (1, "deprel", "obj")),
    _edit(3, "obl-should-be-nmod", (3, "deprel", "obl")),
    _edit(3, "orphan-parent", (3, "deprel", "orphan")),
    _edit(3, "leaf-det", (1, "head", "3"), (1, "deprel", "amod")),
    _edit(3, "leaf-mark-case", (1, "head", "3"), (1, "deprel", "amod"), (3, "deprel", "case"), (3, "upos", "ADP")),
    _edit(3, "leaf-aux-cop", (1, "head", "3"), (1, "deprel", "amod"), (3, "deprel", "aux"), (3, "upos", "AUX")),
    _edit(3, "leaf-cc", (1, "head", "3"), (1, "deprel", "amod"), (3, "deprel", "cc"), (3, "upos", "CCONJ")),
    _edit(3, "leaf-clf", (1, "head", "3"), (1, "deprel", "amod"), (3, "deprel", "clf")),
    _edit(3, "leaf-punct", (4, "head", "5")),
    _edit(3, "leaf-fixed fixed-without-extpos", (5, "deprel", "fixed"), (5, "upos", "ADV"), (5, "head", "4"), (1, "head", "5"), (1, "deprel", "amod")),
    _edit(3, "fixed-gap", (5, "deprel", "fixed"), (5, "upos", "ADV"), (5, "head", "3"), (3, "feats", "ExtPos=DET|PronType=Art")),
    _with(3, "", rows=_goes("Case=Acc|Typo=Yes", "5\tok\t_\tX\t_\t_\t4\tgoeswith\t4:goeswith\t_"), comments=_SPLIT_TEXT),
    _with(3, "goeswith-missing-typo", rows=_goes("Case=Acc", "5\tok\t_\tX\t_\t_\t4\tgoeswith\t4:goeswith\t_"), comments=_SPLIT_TEXT),
    _with(3, "goeswith-lemma goeswith-upos goeswith-feats goeswith-edeps", rows=_goes("Case=Acc|Typo=Yes", "5\tok\tok\tNOUN\t_\tCase=Acc\t4\tgoeswith\t2:obj|4:goeswith\t_"), comments=_SPLIT_TEXT),
    _with(3, "goeswith-nospace", rows=_goes("Case=Acc|Typo=Yes", "5\tok\t_\tX\t_\t_\t4\tgoeswith\t4:goeswith\t_", "SpaceAfter=No"), comments=("# sent_id = {id}", "# text = She reads the book .")),
    _edit(3, "goeswith-gap", (5, "upos", "X"), (5, "lemma", "_"), (5, "deprel", "goeswith"), (5, "head", "3"), (3, "feats", "PronType=Art|Typo=Yes"), (3, "deprel", "det"), (5, "deps", "_")),
    _edit(3, "punct-causes-nonproj punct-is-nonproj", (3, "deprel", "punct"), (3, "upos", "PUNCT"), (3, "feats", "_"), (3, "head", "5"), (1, "head", "4"), (1, "deprel", "nmod"), (5, "upos", "SYM"), (5, "deprel", "nmod")),
    _edit(3, "punct-is-nonproj", (5, "head", "3"), (4, "head", "2")),
    # Levels 4 and 5
    _edit(4, "invalid-word-with-space", (4, "lemma", "the book")),
    _edit(4, "", (4, "lemma", "a lot")),
    _edit(4, "feature-unknown", (4, "feats", "Tone=Up")),
    _edit(4, "feature-not-permitted", (4, "feats", "Degree=Pos")),
    _edit(4, "feature-value-unknown", (4, "feats", "Case=Gen")),
    _edit(4, "feature-upos-not-permitted", (4, "feats", "Mood=Ind")),
    _edit(4, "", (4, "feats", "Tone=Up"), (4, "misc", "SpaceAfter=No|Lang=en"), (4, "feats", "Case=Acc")),
    _edit(4, "unknown-deprel", (4, "deprel", "obj:agent")),
    _edit(4, "unknown-edeprel", (4, "deps", "2:obj:in")),
    _edit(4, "", (4, "deps", "2:obl:in")),
    _edit(5, "aux-lemma", (3, "upos", "AUX"), (3, "deprel", "aux"), (3, "lemma", "may"), (3, "feats", "_")),
    _edit(5, "cop-lemma", (3, "upos", "AUX"), (3, "deprel", "cop"), (3, "lemma", "have"), (3, "feats", "_")),
]
#: Which of the findings are warnings.
WARNINGS = {"empty-misc", "empty-misc-key", "misc-extra-space", "misc-attr-typo", "pron-det-without-prontype", "verbform-fin-without-mood", "fixed-without-extpos", "flat-foreign-upos-feats", "orphan-parent", "fixed-gap"}
