"""Level 6: entities, bridging and split antecedents in MISC.

Brackets are matched within a sentence, which yields its own findings and its mentions. Whether mentions of one
entity agree, and whether an entity stays within its document, is decided over all mentions of a treebank by
aggregates keyed by entity, so a treebank is not one task. The declaration of attributes is a treebank's first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.operators.checks import Found, error, warning
from arborlake.operators.sentence import Node, Tree, per_sentence

# The declaration's order, entity types, and the statements' languages.
ORDER = ("eid", "etype", "head")
TYPES = {"", "person", "place", "organization", "animal", "plant", "object", "substance", "time", "number", "abstract", "event", "other"}
DECLARATION = re.compile(r"#\s*global\.Entity\s*=\s*(.+)")
STATEMENT = re.compile(r"(?:\([^( )]+\)?|[^( )]+\))+")
PIECE = re.compile(r"\(([^( )]+)\)|\(([^( )]+)|([^( )]+)\)")
BRIDGE = re.compile(r"([^(< :>)]+)<([^(< :>,)]+)(?::([a-z]+))?")
SPLIT = re.compile(r"([^(< :>)]+)<([^(< :>,)]+)")
MENTION = "level int, type string, testclass string, testid string, line int, node string, message string, eid string, etype string, identity string, length int"


class Mention(NamedTuple):
    eid: str
    etype: str
    identity: str
    length: int


def declaration(text: str, line: int) -> Iterator[Found]:
    """Findings on a declaration of attributes."""
    wrong = lambda why: error(6, "COREF", "spurious-global-entity", line, why)
    if not re.fullmatch(r"[a-z]+(-[a-z]+)*", text):
        yield wrong(text)
        return
    names = text.split("-")
    for i, name in enumerate(ORDER):
        if names[i : i + 1] != [name]:
            yield wrong(f"{name} is not number {i + 1}")
    if "other" in names and names[3:4] != ["other"]:
        yield wrong("other is not number 4")
    for name in {x for x in names if names.count(x) > 1}:
        yield wrong(f"{name} twice")


class Open(NamedTuple):
    name: str
    begin: int
    head: int
    node: Node


def split_id(name: str) -> tuple[str, int, int]:
    """Entity, part and number of parts of `e[1/2]`."""
    m = re.fullmatch(r"(.+)\[([1-9][0-9]*)/([1-9][0-9]*)\]", name)
    return (m[1], int(m[2]), int(m[3])) if m else (name, 1, 1)


def brackets(raw: str, declared: str | None) -> Iterator[tuple[Found | None, Mention | None]]:
    tree = Tree(raw)
    names = (declared or "").split("-")
    index = {x: i for i, x in reversed(list(enumerate(names)))}
    for line, c in enumerate(tree.comments, 1):
        if m := DECLARATION.fullmatch(c):
            if declared is not None and m[1] != declared:
                yield error(6, "COREF", "global-entity-mismatch", line, m[1]), None
            yield from ((f, None) for f in declaration(m[1], line))
    order = [n for n in tree.nodes if n.kind != "range"]
    at = {id(n): i for i, n in enumerate(order)}
    opened: list[Open] = []
    parts: dict[tuple[str, int], list[dict]] = {}
    spans: dict[str, list[frozenset[int]]] = {}
    for n in tree.nodes:
        cells = n.misc.split("|")
        of = {k: [x[len(k) + 1 :] for x in cells if x.startswith(k + "=")] for k in ("Entity", "Bridge", "SplitAnte")}
        if not any(of.values()):
            continue
        say = lambda testid, message="", kind=error: (kind(6, "COREF", testid, n, message), None)  # noqa: B023, E731
        misplaced = next((t for t, c in (("entity-mwt", n.kind == "range"), ("multiple-entity-statements", len(of["Entity"]) > 1), ("multiple-bridge-statements", len(of["Bridge"]) > 1), ("multiple-splitante-statements", len(of["SplitAnte"]) > 1), ("bridge-without-entity", bool(of["Bridge"]) and not of["Entity"]), ("splitante-without-entity", bool(of["SplitAnte"]) and not of["Entity"]), ("entity-without-global-entity", declared is None)) if c), None)
        if misplaced:
            yield say(misplaced)
            continue
        statement, i, started = of["Entity"][0], at[id(n)], set()
        if not STATEMENT.fullmatch(statement) or "eid" not in index:
            yield say("spurious-entity-statement", statement)
            continue
        ended: set[tuple[int, frozenset[int]]] = set()
        seen_open = seen_close = seen_single = False
        for m in PIECE.finditer(statement):
            single, left, right = m.groups()
            values = (single or left or right).split("-")
            name = values[index["eid"]] if not right else values[0]
            if len(values) > (1 if right else len(names)):
                yield say("too-many-entity-attributes", m[0])
            # Closing brackets come first, then whole mentions, then opening ones.
            if (left and seen_single and (seen_open or not seen_close)) or (single and seen_close and not seen_open and False) or (right and seen_open):
                yield say("spurious-entity-statement", statement)
            seen_open, seen_close, seen_single = seen_open or bool(left), seen_close or bool(right), bool(single) or (seen_single and not left)
            eid, part, n_parts = split_id(name)
            if (n_parts == 1 and name != eid) or part > n_parts or name[:1] in "[]":
                yield say("spurious-entity-id", name)
            if not right:
                value = lambda k: values[index[k]] if k in index and len(values) > index[k] else ""  # noqa: B023, E731
                etype, identity, head = value("etype"), value("identity"), 0
                if etype not in TYPES:
                    yield say("spurious-entity-type", etype)
                if value("head") and not re.fullmatch("[1-9][0-9]*", value("head")):
                    yield say("spurious-mention-head", value("head"))
                elif value("head"):
                    head = int(value("head"))
                if n_parts > 1:
                    rest = "-".join(v for j, v in enumerate(values) if j != index["eid"])
                    held = parts.setdefault((eid, n_parts), [])
                    if part == 1:
                        held.append({"last": 1, "rest": rest, "span": frozenset()})
                    elif not held or held[-1]["last"] + 1 != part:
                        yield say("misplaced-mention-part", name)
                        held or held.append({"last": part, "rest": rest, "span": frozenset()})
                    elif held[-1]["rest"] != rest:
                        yield say("mention-attribute-mismatch", name)
                if part == 1:
                    started.add(eid)
                    yield None, Mention(eid, etype, identity, 0)
                opened.append(Open(name, i, head, n))
            if left:
                continue
            match = next((k for k in range(len(opened) - 1, -1, -1) if opened[k].name == name), None)
            if match is None:
                yield say("ill-nested-entities", name)
                continue
            if match != len(opened) - 1:
                yield say("ill-nested-entities-warning", name, warning)
            mention = opened.pop(match)
            span = frozenset(range(mention.begin, i + 1))
            if n_parts > 1 and parts.get((eid, n_parts)):
                held = parts[eid, n_parts][-1]
                held["last"], held["span"] = part, held["span"] | span
                span = held["span"]
                if part == n_parts:
                    parts[eid, n_parts].pop()
            if part != n_parts:
                continue
            if mention.head > len(span):
                yield say("mention-head-out-of-range", name)
            if (mention.begin, span) in ended:
                yield say("same-span-entity-mentions", name)
            ended.add((mention.begin, span))
            if any(x & span and not x <= span and not span <= x for x in spans.get(eid, ())):
                yield say("crossing-mentions-same-entity", name)
            spans.setdefault(eid, []).append(span)
        yield from relations(n, of, started)
    if opened or any(parts.values()):
        yield error(6, "COREF", "cross-sentence-mention", opened[0].node if opened else 1), None


def relations(n: Node, of: dict[str, list[str]], started: set[str]) -> Iterator[tuple[Found, None]]:
    say = lambda testid, message="": (error(6, "COREF", testid, n, message), None)
    for key, pattern, kind in (("Bridge", BRIDGE, "bridge"), ("SplitAnte", SPLIT, "splitante")):
        for statement in of[key]:
            items = [pattern.fullmatch(x) for x in statement.split(",")]
            if not all(items):
                yield say(f"spurious-{kind}-statement", statement)
                continue
            pairs = [(m[1], m[2]) for m in items]
            for k, (source, target) in enumerate(pairs):
                if source == target:
                    yield say(f"spurious-{kind}-relation", statement)
                elif target not in started:
                    yield say(f"misplaced-{kind}-statement", statement)
                if (source, target) in pairs[:k]:
                    yield say(f"repeated-{kind}-relation", statement)
            if kind == "splitante":
                for target in sorted({t for _, t in pairs}):
                    if sum(t == target for _, t in pairs) == 1:
                        yield say("only-one-split-antecedent", statement)


def found(sentences: DataFrame, keys: tuple[str, ...], treebank: str) -> DataFrame:
    """Incidents of sentences alone, and rows of type MENTION; the declaration is the treebank's first, by the keys."""
    value = F.regexp_extract(F.get(F.filter(F.split("raw", "\n"), lambda c: c.rlike(r"\A#\s*global\.Entity\s*=\s*\S")), F.lit(0)), r"=\s*(.+)\z", 1)
    first = sentences.withColumn("_declared", value).where("_declared <> ''").groupBy(treebank).agg(F.min_by("_declared", F.struct(*keys)).alias("declared"))

    def step(raw: str, declared: str | None):
        for f, m in brackets(raw, declared):
            yield (*f, "", "", "", 0) if f is not None else (6, "MENTION", "", "", 0, "", "", *m)

    return per_sentence(sentences.join(F.broadcast(first), treebank, "left").select(*keys, "raw", "declared"), keys, step, MENTION)  # a row for each treebank


def across(rows: DataFrame, keys: tuple[str, ...], treebank: str, document: str) -> DataFrame:
    """Mentions whose type or identity is not that of the entity's first one, and entities in several documents.

    Of mentions in one sentence the first is that of least type, then identity.
    """
    mentions = rows.where("type = 'MENTION'")
    place = F.struct(*keys)
    first = mentions.groupBy(treebank, "eid").agg(F.min(F.struct(place.alias("place"), "etype", "identity", document)).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    both = mentions.join(first, [treebank, "eid"])
    kinds = F.array(
        F.when(F.col("etype") != F.col("first.etype"), "entity-type-mismatch"), F.when(F.col("identity") != F.col("first.identity"), "entity-identity-mismatch"),
        F.when(F.col(document) != F.col(f"first.{document}"), "entity-across-newdoc"),
    )
    return both.select(*keys, F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("testid"), "eid")


def clusters(rows: DataFrame, treebank: str) -> DataFrame:
    """Mentions of each entity, and its type."""
    return rows.where("type = 'MENTION'").groupBy(treebank, "eid").agg(F.count("*").alias("n_mentions"), F.min("etype").alias("etype")).withColumn("rank", F.row_number().over(W.partitionBy(treebank).orderBy(F.desc("n_mentions"), "eid")))
