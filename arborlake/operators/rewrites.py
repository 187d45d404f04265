"""Rewrites of sentences: conversions, repairs, and annotation copied between versions of one text.

Rules of single nodes are expressions over the sentence's array of nodes. Repairs that follow the text, and
alignments of two versions of a sentence, are steps over one row; versions meet by key, not by position.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType, _parse_datatype_string

from arborlake.operators.columns import batches as batches_of
from arborlake.operators.graphs import reachable, rewritten
from arborlake.operators.sentence import Tree, per_sentence, universal
from arborlake.operators.versions import _begins as begins_of
from arborlake.sources import cells, conllu
from arborlake.sources.cells import SLICE, Nodes, lists
from arborlake.sources.conllu import COLUMNS
from arborlake.sources.registry import RELATIONS, UPOS

# Expressions: nodes in, nodes out.


def basic_to_enhanced(nodes: Column, replace: bool = False) -> Column:
    """The basic edge among the enhanced ones, by head and label; `replace` drops the others."""

    def one(n: Column) -> Column:
        basic = F.concat(n["head"], F.lit(":"), n["deprel"])
        deps = basic if replace else F.when(n["deps"] == "_", basic).otherwise(conllu.sorted_edges(F.concat(n["deps"], F.lit("|"), basic)))
        return F.when(n["kind"] == "word", n.withField("deps", deps)).otherwise(n)

    return F.transform(nodes, one)


def without_enhanced(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: n.withField("deps", F.lit("_")))


def sorted_deps(nodes: Column) -> Column:
    """Edges from the root are labelled root; edges are by head and label."""
    fixed = lambda deps: F.array_join(F.transform(F.split(deps, r"\|"), lambda x: F.when(x.startswith("0:"), "0:root").otherwise(x)), "|")
    return F.transform(nodes, lambda n: n.withField("deps", F.when(n["deps"] == "_", "_").otherwise(conllu.sorted_edges(fixed(n["deps"])))))


def conllx(nodes: Column) -> Column:
    """Lines of the older format: words alone, tags fused, no spaces in forms, two last columns empty."""
    spaced = lambda c: F.regexp_replace(c, r"(?U)\s", "_")
    tag = lambda n: F.when(n["xpos"] == "_", n["upos"]).otherwise(F.concat(n["upos"], F.lit("_"), n["xpos"]))
    line = lambda n: F.concat_ws("\t", n["id"], spaced(n["form"]), spaced(n["lemma"]), n["upos"], tag(n), n["feats"], n["head"], n["deprel"], F.lit("_"), F.lit("_"))
    return F.transform(F.filter(nodes, lambda n: n["kind"] == "word"), line)


def plain_lemmas(nodes: Column) -> Column:
    """Punctuation is its own lemma; a number at a lemma's end goes, the original to MISC, where the form has no digit."""

    def one(n: Column) -> Column:
        strip = (n["kind"] == "word") & ~n["form"].rlike("[0-9]") & n["lemma"].rlike(r"[^0-9-]-?[0-9]+\z")
        kept = F.regexp_replace(n["lemma"], r"-?[0-9]+\z", "")
        misc = F.when(n["misc"] == "_", F.concat(F.lit("LId="), n["lemma"])).otherwise(F.concat(n["misc"], F.lit("|LId="), n["lemma"]))
        return F.when((n["kind"] == "word") & (n["upos"] == "PUNCT"), n.withField("lemma", n["form"])).when(strip, n.withField("misc", misc).withField("lemma", kept)).otherwise(n)

    return F.transform(nodes, one)


def converted_tags(nodes: Column, mapping: dict[tuple[str, str, str], tuple[str, str]]) -> Column:
    """Tags and features by a table of (upos, xpos, feats) to (upos, feats) that the caller brings; others stay.

    A tagset is small; the table travels as one literal, so its size is checked.
    """
    if len(mapping) > 50_000:
        raise ValueError("a tag table of over 50,000 entries: join it instead")
    table = json.dumps({"\t".join(k): {"upos": u, "feats": f} for k, (u, f) in mapping.items()})
    by_tag = F.from_json(F.lit(table), "map<string, struct<upos: string, feats: string>>")

    def one(n: Column) -> Column:
        new = F.try_element_at(by_tag, F.concat_ws("\t", n["upos"], n["xpos"], n["feats"]))
        return F.when((n["kind"] == "mwt") | new.isNull(), n).otherwise(n.withField("upos", new["upos"]).withField("feats", new["feats"]))

    return F.transform(nodes, one)


def tags_to_xpos(nodes: Column, mapping: dict[tuple[str, str], str]) -> Column:
    """XPOS by a table of (upos, feats); `_` where the table has none or only white space."""
    if len(mapping) > 50_000:
        raise ValueError("a tag table of over 50,000 entries: join it instead")
    by_tag = F.from_json(F.lit(json.dumps({"\t".join(k): " ".join(v.split()) or "_" for k, v in mapping.items()})), "map<string, string>")
    of = lambda n: F.coalesce(F.try_element_at(by_tag, F.concat_ws("\t", n["upos"], n["feats"])), F.lit("_"))
    return F.transform(nodes, lambda n: F.when(n["kind"] == "word", n.withField("xpos", of(n))).otherwise(n))


def with_parallel(comments: Column, ids: str = "[nw][0-9]+", group: str = "pud") -> Column:
    """`parallel_id = group/id` after each sentence id that is one of `ids`."""
    pattern = rf"\A#\s*sent_id\s*=\s*({ids})\z"
    added = lambda x: F.concat(F.lit(f"# parallel_id = {group}/"), F.regexp_extract(x, pattern, 1))
    return F.flatten(F.transform(comments, lambda x: F.when(x.rlike(pattern), F.array(x, added(x))).otherwise(F.array(x))))


def applied(trees: DataFrame, step: Callable[[Column], Column]) -> DataFrame:
    return trees.withColumn("nodes", step(F.col("nodes"))).withColumn("raw", conllu.rendered(F.col("comments"), F.col("nodes")))


# The same rules over batches: rows of sentences (keys, raw) that are read whole, without arrays of nodes.


def conllx_lines(sentences: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, line: conllx() of each word."""

    def spaced(texts: pa.Array) -> pa.Array:
        known = texts.dictionary_encode()  # forms recur
        return pc.replace_substring_regex(known.dictionary, r"[\t\n\x0b\f\r\x{85}\pZ]", "_").take(known.indices)

    def step(raw: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        nodes = cells.Nodes(raw)
        word = nodes.word
        of = lambda c: nodes[c].filter(pa.array(word))
        upos, xpos = of("upos"), of("xpos")
        tag = pc.if_else(pc.equal(xpos, "_"), upos, pc.binary_join_element_wise(upos, xpos, "_"))
        return nodes.of[word], [pc.binary_join_element_wise(of("id"), spaced(of("form")), spaced(of("lemma")), upos, tag, of("feats"), of("head"), of("deprel"), "_", "_", "\t")]

    return cells.per_batch(sentences, keys, step, "line string")


def enhanced_words(sentences: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, id, deps: basic_to_enhanced() of each word."""

    def step(raw: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        nodes = cells.Nodes(raw)
        word = nodes.word
        of = lambda c: nodes[c].filter(pa.array(word))
        deps, basic = of("deps"), pc.binary_join_element_wise(of("head"), of("deprel"), ":")
        more = pc.and_(pc.not_equal(deps, "_"), pc.not_equal(deps, basic))
        at = np.flatnonzero(np.asarray(more))
        both = cells.sorted_edges(pc.binary_join_element_wise(deps.take(pa.array(at)), basic.take(pa.array(at)), "|"))
        return nodes.of[word], [of("id"), pc.replace_with_mask(basic, more, both) if len(at) else basic]

    return cells.per_batch(sentences, keys, step, "id string, deps string")


def _fixed(deps: pa.Array) -> pa.Array:
    rooted = pc.match_substring(deps, "0:")
    if pc.any(rooted).as_py():
        deps = pc.replace_with_mask(deps, rooted, pc.replace_substring_regex(deps.filter(rooted), r"(^|\|)0:[^|]*", r"\10:root"))
    return cells.sorted_edges(deps)


def fixed_deps(sentences: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, raw: the texts with sorted_deps()."""

    def step(raw: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        nodes = cells.Nodes(raw)
        return np.arange(len(raw)), [nodes.rendered({"deps": _fixed(nodes["deps"])})]

    return cells.per_batch(sentences, keys, step, "raw string")


def fixed_deps_of_words(sentences: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, id, deps: sorted_deps() of each word."""

    def step(raw: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        nodes = cells.Nodes(raw)
        word = pa.array(nodes.word)
        return nodes.of[nodes.word], [nodes["id"].filter(word), _fixed(nodes["deps"].filter(word))]

    return cells.per_batch(sentences, keys, step, "id string, deps string")


def xpos_of_words(sentences: DataFrame, keys: tuple[str, ...], mapping: dict[tuple[str, str], str]) -> DataFrame:
    """keys, id, xpos: tags_to_xpos() of each word."""
    tags, xpos = pa.array(["\t".join(k) for k in mapping], pa.string()), pa.array([" ".join(v.split()) or "_" for v in mapping.values()], pa.string())

    def step(raw: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        nodes = cells.Nodes(raw)
        word = nodes.word
        of = lambda c: nodes[c].filter(pa.array(word))
        found = pc.index_in(pc.binary_join_element_wise(of("upos"), of("feats"), "\t"), value_set=tags)
        return nodes.of[word], [of("id"), pc.fill_null(xpos.take(found), "_")]

    return cells.per_batch(sentences, keys, step, "id string, xpos string")


def unspaced_lines(text: Column, width: int = 80) -> Column:
    """Text without white space in lines of `width` characters."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s", ""), rf"(.{{{width}}})(?=.)", "$1\n")


def spaced_before_paragraphs(sentences: DataFrame, keys: tuple[str, ...], file: str) -> DataFrame:
    """keys, raw, changed: a sentence ahead of one that begins a paragraph or document loses SpaceAfter=No at its last token.

    What the next sentence begins is looked up over narrow rows of the file. Only sentences whose last token says
    SpaceAfter=No meet them; the others' texts are not moved. A last word inside a range leaves the space to the range.
    """
    marks = cells.per_batch(sentences, keys, _glued, "raw string, fixed string")
    ahead = cells.per_batch(sentences, keys, _begins, "begins boolean").withColumn("before_break", F.lead("begins").over(W.partitionBy(file).orderBy(*keys))).where("before_break").select(*keys, "before_break")
    met = marks.where("fixed is not null").select(*keys, "raw", "fixed").join(ahead, list(keys), "left")
    changed = F.col("before_break").isNotNull()
    glued = met.select(*keys, F.when(changed, F.col("fixed")).otherwise(F.col("raw")).alias("raw"), changed.alias("changed"))
    return glued.unionByName(marks.where("fixed is null").select(*keys, "raw", F.lit(False).alias("changed")))


def _begins(raw: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Whether each text begins a paragraph or document."""
    of, lines = cells.split(raw, "\n")
    comment = cells.firsts(lines) == ord("#")
    begins = np.zeros(len(raw), bool)
    begins[of[comment][np.asarray(pc.match_substring_regex(lines.filter(pa.array(comment)), r"\A#[\s\x0b]*new(doc|par)([\s\x0b]|\z)"))]] = True
    return np.arange(len(raw)), [pa.array(begins)]


def _glued(raw: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Each text, and it without SpaceAfter=No at its last token (null: it has none there)."""
    nodes = cells.Nodes(raw)
    # The last surface token: the last range that reaches the last word, else that word.
    surface = np.flatnonzero(cells.like(nodes["id"], r"\A[0-9]+(-[0-9]+)?\z") & (nodes.many > 1))
    last = np.full(len(raw), -1)
    last[nodes.of[surface]] = surface
    token = last.copy()
    ranges = surface[nodes.ranged[surface]]
    number = lambda at: np.array([int(x.rpartition("-")[2]) for x in nodes["id"].take(pa.array(at)).to_pylist()], dtype=object)
    if len(ranges):
        reaching = ranges[(number(ranges) >= number(last[nodes.of[ranges]])).astype(bool)]
        token[nodes.of[reaching]] = reaching
    there = np.flatnonzero(token >= 0)
    misc = nodes["misc"].take(pa.array(token[there]))
    fixed: list[str | None] = [None] * len(raw)
    for k in np.flatnonzero(np.asarray(pc.match_substring_regex(misc, r"(\A|\|)SpaceAfter=No(\||\z)"))):
        sentence, line = there[k], nodes.line[token[there[k]]].as_py()
        left = "|".join(x for x in misc[k].as_py().split("|") if x != "SpaceAfter=No") or "_"
        new = "\t".join([*line.split("\t")[:9], left])
        fixed[sentence] = "\n".join(new if x == line else x for x in raw[sentence].as_py().split("\n"))
    return np.arange(len(raw)), [raw, pa.array(fixed, pa.string())]


# Steps: one sentence's text in, its text out.


def renumbered(raw: str) -> str:
    """Words numbered from 1 in order; a head becomes the new number of the first word that had its id, or 0."""
    lines = raw.split("\n")
    old: dict[str, int] = {}
    words = [k for k, x in enumerate(lines) if re.match("[0-9]+\t", x)]
    for i, k in enumerate(words, 1):
        old.setdefault(lines[k].partition("\t")[0], i)
    for i, k in enumerate(words, 1):
        c = lines[k].split("\t")
        c[0], c[6] = str(i), c[6] if c[6] == "_" else str(old.get(c[6], 0))
        lines[k] = "\t".join(c)
    return "\n".join(lines)


def composed(raw: str) -> str:
    return unicodedata.normalize("NFC", raw)


def _feature(part: str) -> str:
    name, equals, value = part.rpartition("=")
    name, value = (name, value) if equals and name and value else (part, "Yes")
    name, value = re.sub(r"[^A-Za-z\[\]]", "", name), re.sub("[^A-Za-z0-9,]", "", value)
    name, value = name[:1].upper() + name[1:], value[:1].upper() + value[1:]
    name, value = (name if re.match("[A-Z]", name) else "X" + name), (value if re.match("[A-Z0-9]", value) else "X" + value)
    return f"{name}={','.join(sorted(value.split(',')))}"


def quick_fixed(raw: str, connect: bool = False) -> str:
    """Makes a sentence pass the checks of its format, whatever it holds; what it cannot keep it replaces by defaults."""
    lines = unicodedata.normalize("NFC", raw).split("\n")
    root = None
    for k, line in enumerate(lines):
        if not line[:1].isdigit():
            continue
        c = (line.split("\t") + ["_"] * 10)[:10]
        if "-" in c[0]:
            c[2:9] = ["_"] * 7
        else:
            empty = "." in c[0]
            c[2], c[4] = c[2].strip() or "_", c[4].strip() or "_"
            if not (empty and c[3] == "_"):
                c[3] = c[3] if c[3] in UPOS else "X"
            if c[5] != "_":
                c[5] = "|".join(sorted(map(_feature, c[5].split("|")), key=str.lower))
            if empty:
                c[6] = c[7] = "_"
            else:
                c[6], c[7], root = _attached(c, root)
            c[8] = _edges(c[0], c[8])
        lines[k] = "\t".join(c)
    lines = _spaced(lines)
    fixed = "\n".join(lines)
    return reachable(fixed) if connect else fixed


def _attached(c: list[str], root: str | None) -> tuple[str, str, str | None]:
    head, rel = c[6], c[7]
    if not head.isdigit():
        head, rel = ("0", "root") if c[0] == "1" else ("1", rel if rel not in ("_", "") else "punct" if c[3] == "PUNCT" else "dep")
    if universal(rel) == "root" and head != "0":
        rel = "dep"
    if universal(rel) != "root" and head == "0":
        rel = "root"
    valid = lambda r: universal(r) in RELATIONS and re.fullmatch("[a-z]+(:[a-z]+)?", r)
    rel = rel if valid(rel) else universal(rel) if valid(universal(rel)) else "dep"
    if head == "0":
        if root is not None and root != c[0]:
            return root, "parataxis", root
        root = c[0]
    return head, rel, root


def _edges(own: str, cell: str) -> str:
    if cell == "_":
        return cell
    kept = []
    for part in cell.split("|"):
        m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?):(.+)", part)
        if m and m[1] != own:
            rel = re.sub(r"[^\w:]", "", m[2].lower())
            rel = "root" if m[1] == "0" else rel if universal(rel) in (*RELATIONS, "ref") and universal(rel) != "root" else "dep"
            kept.append((tuple(int(x) for x in (m[1] + ".0").split(".")[:2]), m[1], rel))
    kept = sorted(set(kept)) or [((0, 0), "0", "root")]
    return "|".join(f"{h}:{d}" for _, h, d in kept)


def _spaced(lines: list[str]) -> list[str]:
    """SpaceAfter=No as the text comment says; without one, the text as SpaceAfter says. Adds a missing text; ids need the file, see `named`."""
    text = next((m[1] for x in lines if (m := re.fullmatch(r"#\s*text\s*=\s*(.+)", x))), None)
    rest, until, made = text, 0, ""
    for k, line in enumerate(lines):
        if not line[:1].isdigit():
            continue
        c = line.split("\t")
        misc = [x for x in c[9].split("|") if x != "_"]
        ranged = re.fullmatch("([0-9]+)-([0-9]+)", c[0])
        if "." in c[0]:
            continue
        if not ranged and int(c[0]) <= until:
            misc = [x for x in misc if x != "SpaceAfter=No"]
        else:
            until = int(ranged[2]) if ranged else 0
            if rest is not None and rest.startswith(c[1]):
                rest = rest[len(c[1]) :]
                if rest:
                    glued = not rest[0].isspace()
                    misc = [x for x in misc if x != "SpaceAfter=No"] + ["SpaceAfter=No"] * glued
                    rest = rest.lstrip()
            else:
                rest = None
            made += c[1] + ("" if "SpaceAfter=No" in misc else " ")
        c[9] = "|".join(misc) or "_"
        lines[k] = "\t".join(c)
    return lines if text is not None else [f"# text = {made.rstrip()}", *lines]


def named(sentences: DataFrame, number: str) -> DataFrame:
    """Adds a missing sent_id: the sentence's number."""
    missing = ~F.col("raw").rlike(r"(?m)^#\s*sent_id\s*=\s*\S")
    return sentences.withColumn("raw", F.when(missing, F.concat(F.lit("# sent_id = "), F.col(number).cast("string"), F.lit("\n"), F.col("raw"))).otherwise(F.col("raw")))


def quick_fix(sentences: DataFrame, keys: tuple[str, ...], number: str, connect: bool = False) -> DataFrame:
    return named(rewritten(sentences, keys, lambda raw: quick_fixed(raw, connect)), number)


def wrapped(pieces: list[str], width: int = 80, anywhere: bool = False) -> str:
    """Paragraphs of lines of at most `width` characters where words allow; `anywhere` breaks within words, but not in Latin letters or digits."""
    out = []
    for paragraph in pieces:
        units = re.findall(r"[A-Za-z0-9À-ɏ]+|\s+|.", paragraph) if anywhere else re.findall(r"\S+|\s+", paragraph)
        line, lines = "", []
        for u in units:
            if line and len(line) + len(u.rstrip()) > width:
                lines.append(line.rstrip())
                line = ""
            if line or not u.isspace():
                line += u
        out.append("\n".join([*lines, line.rstrip()] if line.strip() else lines))
    return "\n\n".join(out)


BEGINS = re.compile(r"#\s*new(doc|par)(\s|\Z)", re.ASCII)


def spoken(raw: str | None) -> Iterator[tuple[bool, str]]:
    """Whether a sentence begins a paragraph, and its text: ranges and the words outside of them, each with its space.

    Ranges are merged first, so that each word is looked up once, however long the sentence.
    """
    lines = (raw or "").split("\n")
    number = lambda x: int(x) if x.isascii() and x.isdigit() and int(x) < 1 << 31 else 0
    shown: list[tuple[int | None, list[str]]] = []
    spans: list[tuple[int, int]] = []
    for line in lines:
        if line[:1].isascii() and line[:1].isdigit():
            cells = line.split("\t")
            first = cells[0]
            if "-" in first:
                spans.append((number(first.split("-")[0].split(".")[0]), number(first.rsplit("-", 1)[1])))
                shown.append((None, cells))
            elif "." not in first:
                shown.append((number(first), cells))
    begins: list[int] = []
    ends: list[int] = []
    for low, high in sorted(spans):
        if ends and low <= ends[-1]:
            ends[-1] = max(ends[-1], high)
        elif low <= high:
            begins.append(low)
            ends.append(high)
    out = []
    for n, cells in shown:
        if n is None or not ((k := bisect_right(begins, n)) and n <= ends[k - 1]):
            out.append(cells[1] if len(cells) > 1 else "_")
            if len(cells) < 10 or "SpaceAfter=No" not in cells[9].split("|"):
                out.append(" ")
    yield any(BEGINS.match(x) for x in lines), "".join(out)


def paragraphs(sentences: DataFrame, document: tuple[str, ...], order: str) -> DataFrame:
    """document, paragraph (from 1), text: the sentences (raw) of each paragraph by their order, joined by their spacing.

    `newdoc` and `newpar` begin a paragraph. The texts are dealt by document once; numbers and texts of paragraphs are
    made there, row by row, and no value holds more than a paragraph. Sentences without text give empty paragraphs.
    """
    rows = per_sentence(sentences.select(*document, order, "raw"), (*document, order), spoken, "_begins boolean, _text string")
    # What Spark windows over and groups by here is clustered by the document already: one exchange.
    inside = W.partitionBy(*document).orderBy(order)
    first = F.row_number().over(inside) == 1
    rows = rows.withColumn("_first", first)
    rows = rows.withColumn("paragraph", F.sum((F.col("_begins") | F.col("_first")).cast("int")).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_text"))), lambda x: x["_text"]), "")
    return rows.groupBy(*document, "paragraph").agg(F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "").alias("text"))


def filled(text: Column, width: int = 80) -> Column:
    """The lines of a paragraph: as many words as fit into the width, and longer words alone. One expression finds them all."""
    found = F.regexp_extract_all(text, F.lit(rf"(?Us)\S.{{0,{width - 1}}}(?=\s|\z)|\S+"), 0)
    return F.transform(found, lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))


def document_lines(sentences: DataFrame, document: tuple[str, ...], order: str, width: int = 80) -> DataFrame:
    """document, paragraph, line (from 1), text: a document's text in lines, one row each, so that long documents stay in many rows."""
    rows = paragraphs(sentences, document, order)
    return rows.select(*document, "paragraph", F.posexplode(filled(F.col("text"), width)).alias("_at", "text")).select(*document, "paragraph", (F.col("_at") + 1).alias("line"), "text")


def document_text(sentences: DataFrame, document: tuple[str, ...], order: str, language: str = "") -> DataFrame:
    """The plain text of each document (keys, order, raw): sentences joined by their spacing, paragraphs apart, lines wrapped.

    A document's text is one value, as long as the document. Only languages whose lines break within words (zh, ja) take a Python step.
    """
    if language not in ("zh", "ja"):
        parts = paragraphs(sentences, document, order).select(*document, "paragraph", F.array_join(filled(F.col("text")), "\n").alias("_lines"))
        return parts.groupBy(*document).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "_lines"))), lambda x: x["_lines"]), "\n\n").alias("text"))
    gathered = sentences.groupBy(*document).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "raw"))), lambda x: x["raw"]).alias("raws"))  # one document

    def step(raws: list[str]):
        paragraphs: list[str] = []
        for raw in raws:
            tree = Tree(raw)
            if not paragraphs or any(re.match(r"#\s*new(doc|par)(\s|$)", c) for c in tree.comments):
                paragraphs.append("")
            for _, _, lines in surface(tree):
                n = lines[0]
                paragraphs[-1] += n.form + ("" if "SpaceAfter=No" in n.misc.split("|") else " ")
        yield (wrapped([p.strip() for p in paragraphs], anywhere=language in ("zh", "ja")),)

    return per_sentence(gathered.select(*document, "raws"), document, step, "text string")


# Two versions of one text, joined by key.


def surface(tree: Tree) -> list[tuple[int, int, list]]:
    """(begin, end, lines) of each token in the sentence's characters; a range has its words' lines too."""
    out, at, until = [], 0, 0
    for n in tree.nodes:
        if n.kind == "empty":
            continue
        if n.kind == "word" and n.id[0] <= until:
            out[-1][2].append(n)
            continue
        until = n.last if n.kind == "range" else 0
        size = len("".join(n.form.split()))
        out.append((at, at + size, [n]))
        at += size
    return out


def copied(source: str, target: str, columns: tuple[str, ...]) -> str:
    """The target with columns of the source; both must have the same nodes."""
    place = {"lemma": 2, "upos": 3, "xpos": 4, "feats": 5}
    a, b = Tree(source), Tree(target)
    if [n.cells[:2] for n in a.nodes] != [n.cells[:2] for n in b.nodes]:
        raise ValueError("the versions have different nodes")
    for x, y in zip(a.nodes, b.nodes):
        for c in columns:
            y.cells[place[c]] = x.cells[place[c]]
    return b.rendered()


def retokenized(source: str, target: str) -> str:
    """The target in the source's tokens. Where they differ, the source's lines stand with the first target word's tags and no tree."""
    a, b = Tree(source), Tree(target)
    left, right = surface(a), surface(b)
    ends = sorted({e for _, e, _ in left} & {e for _, e, _ in right})
    if not left or not right or left[-1][1] != right[-1][1]:
        raise ValueError("the versions have different characters")
    out, number, i, j = list(b.comments), 0, 0, 0
    for end in ends:
        mine, theirs = [], []
        while i < len(left) and left[i][1] <= end:
            mine += left[i][2]
            i += 1
        while j < len(right) and right[j][1] <= end:
            theirs += right[j][2]
            j += 1
        if len(mine) == len(theirs) == 1:
            number += 1
            out.append("\t".join([str(number), *theirs[0].cells[1:]]))
            continue
        first = next(n for n in theirs if n.kind == "word")
        kept = [x for x in first.misc.split("|") if x not in ("_", "SpaceAfter=No")]
        for n in mine:
            misc = kept + ["SpaceAfter=No"] * ("SpaceAfter=No" in n.misc.split("|"))
            if n.kind == "range":
                cell = f"{number + 1}-{number + 1 + n.last - n.id[0]}"
            else:
                number += 1
                cell = str(number)
            out.append("\t".join([cell, n.form, *first.cells[2:6], "_", "_", "_", "|".join(misc) or "_"]))
    return "\n".join(out)


def restored(parsed: str, original: str) -> str:
    """A parser's CoNLL-X lines with the comments, ranges, empty nodes and forms of the original."""
    rows = iter([x for x in parsed.split("\n") if x[:1].isdigit()])
    out = []
    for line in original.split("\n"):
        if re.match("[0-9]+\t", line):
            cells = next(rows).split("\t")
            cells[1] = line.split("\t")[1]
            line = "\t".join(cells)
        out.append(line)
    return "\n".join(out)


def merged_tags(source: str, target: str) -> str:
    """The target with the source's XPOS where words have equal forms; sentences of different text stay."""
    (_, a), (comments, b) = _parts(source), _parts(target)
    text = lambda nodes: "".join(c[1] for c in nodes if "-" not in c[0] and "." not in c[0])
    if text(a) != text(b):
        return target
    by_id = {c[0]: c for c in a}
    for c in b:
        other = by_id.get(c[0])
        if other is not None and other[1] == c[1]:
            c[4] = other[4]
    return "\n".join([*comments, *map("\t".join, b)])


def _parts(raw: str) -> tuple[list[str], list[list[str]]]:
    """Comments, and the cells of nodes: all that a rewrite needs which follows no edges."""
    lines = raw.split("\n")
    return [x for x in lines if x[:1] == "#"], [x.split("\t") for x in lines if x[:1].isdigit()]


def _slim(raw: pa.Array, columns: tuple[str, ...], comments: bool) -> pa.Array:
    """The texts with `_` in all other columns, with or without comments; texts that are not comments and then lines of ten cells stay."""
    nodes = Nodes(raw)
    other = ~nodes.comment & ~nodes.node
    other[1:] |= nodes.comment[1:] & ~nodes.comment[:-1] & (nodes.all_of[1:] == nodes.all_of[:-1])
    odd = np.bincount(nodes.all_of[other], minlength=len(raw)) + np.bincount(nodes.of[nodes.many != len(COLUMNS)], minlength=len(raw)) > 0
    blank = pa.repeat("_", len(nodes.line))
    if comments:
        text = nodes.rendered({c: blank for c in COLUMNS if c not in columns})
    else:
        line = pc.binary_join_element_wise(*(nodes[c] if c in columns else blank for c in COLUMNS), "\t")
        text = pc.binary_join(lists(np.concatenate([[0], np.cumsum(np.bincount(nodes.of, minlength=len(raw)))]), line), "\n")
    return pc.if_else(pa.array(odd), raw, text) if odd.any() else text


def _packed(df: DataFrame, keys: tuple[str, ...], side: int, columns: tuple[str, ...], comments: bool) -> DataFrame:
    """A row for the sentences of a document that stand together in a batch: their numbers, and their texts' sizes and bytes, compressed."""
    *doc, order = keys
    schema = StructType([*(df.schema[k] for k in doc), *_parse_datatype_string("_side tinyint, _sizes array<int>, _texts binary").fields, StructField("_orders", ArrayType(df.schema[order].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for whole in batches:
            for a, b in batches_of(whole.column("raw"), SLICE):
                batch = whole.slice(a, b - a)
                text = pa.concat_arrays([_slim(batch.column("raw").cast(pa.string()), columns, comments)])
                first = np.flatnonzero(begins_of(batch, doc))
                bounds, at = np.append(first, len(text)), np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(text), dtype=np.int64))])
                data = b"".join(x.encode() for x in text.to_pylist())
                packed = [codec.compress(data[at[x] : at[y]], asbytes=True) for x, y in zip(bounds, bounds[1:])]
                fixed = [*(batch.column(k).take(pa.array(first)) for k in doc), pa.array(np.full(len(first), side, np.int8))]
                yield pa.RecordBatch.from_arrays([*fixed, lists(bounds, pa.array(np.diff(at).astype(np.int32))), pa.array(packed, pa.binary()), lists(bounds, batch.column(order))], names=schema.names)

    return df.where(" and ".join(f"`{k}` is not null" for k in keys)).select(*keys, "raw").mapInArrow(run, schema)


def together(source: DataFrame, target: DataFrame, keys: tuple[str, ...], step: Callable[[str, str], str], columns: tuple[tuple[str, ...], tuple[str, ...]] = (COLUMNS, COLUMNS)) -> DataFrame:
    """Targets rewritten by their sources; both are (keys, raw). `columns` are those that `step` reads of either; it reads no comments of the source.

    All keys but the last name a document. Both sides meet in one exchange of compressed texts, of which the columns
    that nobody reads are blank; behind it, a document of both sides is held.
    """
    *doc, order = keys
    if not doc:
        both = target.select(*keys, "raw").join(source.select(*keys, F.col("raw").alias("_source")), list(keys))
        return per_sentence(both.select(*keys, "_source", "raw"), keys, lambda s, t: [(step(s, t),)], "raw string")
    out_type = StructType([*(target.schema[k] for k in keys), StructField("raw", StringType())])
    arrow = to_arrow_schema(out_type)

    def texts(sizes: list[int], data: bytes) -> Iterator[str]:
        at, data = 0, pa.decompress(data, sum(sizes), codec="zstd", asbytes=True)
        for n in sizes:
            yield data[at : at + n].decode()
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sources, out, size = None, {}, [], 0
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*doc, "_side", "_sizes", "_texts", "_orders")]
            for *own, side, sizes, data, orders in zip(*columns):
                if own != held:
                    held, sources = own, {}
                if side == 0:
                    for i, text in zip(orders, texts(sizes, data)):
                        sources.setdefault(i, []).append(text)
                    continue
                for i, text in zip(orders, texts(sizes, data)) if sources else ():
                    for other in sources.get(i, ()):
                        out.append((*own, i, step(other, text)))
                        size += len(out[-1][-1])
                    if size > SLICE:
                        yield table()
                        out, size = [], 0
        if out:
            yield table()

    met = _packed(source, keys, 0, columns[0], False).unionByName(_packed(target, keys, 1, columns[1], True))
    return met.repartition(*doc).sortWithinPartitions(*doc, "_side").mapInArrow(run, out_type)
