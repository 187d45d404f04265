"""Verse references of parallel scripture: found in attributes or sentence ids, brought to one form, in canonical order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions import pairs

# Labels of the books in canonical order.
BOOKS = """GEN EXOD LEV NUM DEUT JOSH JUDG RUTH 1SAM 2SAM 1KGS 2KGS 1CHR 2CHR EZRA NEH ESTH JOB PS PROV ECCL SONG ISA JER LAM EZEK DAN HOS JOEL AMOS OBAD JONAH MIC NAH HAB ZEPH HAG ZECH MAL
TOB JDT ADDESTH WIS SIR BAR EPJER ADDDAN PRAZAR SGTHREE SUS BEL 1MACC 2MACC 1ESD PRMAN PS151 3MACC 2ESD 4MACC
MATT MARK LUKE JOHN ACTS ROM 1COR 2COR GAL EPH PHIL COL 1THESS 2THESS 1TIM 2TIM TITUS PHLM HEB JAS 1PET 2PET 1JOHN 2JOHN 3JOHN JUDE REV""".split()
# Other names that treebanks give to books.
NAMES = {
    "Genesis": "GEN", "Exodus": "EXOD", "EXO": "EXOD", "Leviticus": "LEV", "Ruth": "RUTH", "RUT": "RUTH",
    "1KGDMS": "1SAM", "2KGDMS": "2SAM", "3KGDMS": "1KGS", "4KGDMS": "2KGS", "PSALM": "PS", "PSALMS": "PS", "PSS": "PS",
    "QOH": "ECCL", "CANT": "SONG", "Habakkuk": "HAB", "JUDIT": "JDT", "MARC": "MARK", "LUCA": "LUKE", "IOAN": "JOHN",
    "PAVEL_ROM": "ROM", "PAVEL_1.CORINT": "1COR", "PAVEL_2.CORINT": "2COR", "PAVEL_GALAT": "GAL", "PAVEL_EFES": "EPH",
    "PAVEL_FILIP": "PHIL", "PAVEL_COLAS": "COL", "PAVEL_SOLUN.1": "1THESS", "PAVEL_SOLUN.2": "2THESS", "PAVEL_TIM.1": "1TIM",
    "PAVEL_TIM.2": "2TIM", "TIT": "TITUS", "PAVEL_TIT": "TITUS", "PHILEM": "PHLM", "PAVEL_FILIMON": "PHLM", "PAVEL_EVREI": "HEB",
    "IACOB": "JAS", "PETRU.1": "1PET", "PETRU.2": "2PET", "IOAN.1": "1JOHN", "IOAN.2": "2JOHN", "IOAN.3": "3JOHN", "IUDA": "JUDE", "IOAN_APOC": "REV",
}
#: Corpora whose sentence ids lead to the book by other words, and the words that make an id a verse of a book's first chapter.
CORPORA, FIRST_CHAPTER = ("Masoretic", "Septuagint", "sahidica", "sahidic", "bohairic"), ("REL", "BIB")


def _names() -> Column:
    return F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))


def _label(name: Column) -> Column:
    """A book's label by its name as written, or with capitals."""
    upper = F.upper(name)
    return F.coalesce(F.try_element_at(_names(), name), F.try_element_at(_names(), upper), F.when(upper.isin(BOOKS), upper))


def _number(word: Column) -> Column:
    """Digits of a word such as `s003` or `4b`, without zeros ahead; null for other words."""
    digits = F.ltrim(F.translate(word, "abcdefghijklmnopqrstuvwxyz", ""), F.lit("0"))
    return F.when(word.rlike(r"\As?[0-9]+[a-z]*\z"), F.when(digits == "", "0").otherwise(digits))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def reference_in_id(sent_id: Column) -> Column:
    """`BOOK_chapter.verse` of a sentence id, with a book known by a full name under its label; else null.

    The id is cut into words. Its book is the first word, or in the ids of `CORPORA` the last word that names one
    ahead of a number; the two words after it are chapter and verse. Words `REL-BIB` after a book (perhaps with
    NT ahead of it) leave the chapter out.
    """

    def found(words: Column) -> Column:
        word = lambda i: F.get(words, i)
        first = F.when(word(F.lit(0)).rlike(r"\A[0-9]*[A-Z][A-Z0-9]*\z") & sent_id.rlike(r"\A[^-.:]+_"), F.lit(0))
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(2)) - 1), lambda i: _number(word(i + 1)).isNotNull() & _label(word(i)).isNotNull())
        place = F.when(word(F.lit(0)).isin(*CORPORA), F.try_element_at(places, F.lit(-1))).otherwise(first)
        plain = _let(place, lambda at: F.concat(F.coalesce(_label(word(at)), word(at)), F.lit("_"), _number(word(at + 1)), F.lit("."), _number(word(at + 2))))
        book = F.coalesce(_label(word(F.lit(1))), _label(F.regexp_replace(word(F.lit(1)), r"\ANT", "")))
        chapterless = F.when((word(F.lit(2)) == FIRST_CHAPTER[0]) & (word(F.lit(3)) == FIRST_CHAPTER[1]), F.concat(book, F.lit("_1."), _number(word(F.lit(4)))))
        return F.coalesce(chapterless, plain)

    return _let(F.split(sent_id, "[^A-Za-z0-9]+"), found)


def part(reference: Column) -> Column:
    """struct(book by its label, index (the rest), chapter, verse); null where the reference has no book or no number.

    The book is the longest known name that the reference begins with ahead of a number, else what comes before
    the first number behind its letters.
    """
    known = sorted({*BOOKS, *NAMES}, key=lambda x: (-len(x), x))

    def made(book: Column, index: Column) -> Column:
        pieces = F.split(index, "[:.]", 2)
        chapter = F.regexp_extract(F.get(pieces, F.lit(0)), r"\A[0-9]+", 0)
        verse = F.when(F.get(pieces, F.lit(0)) == chapter, F.nullif(F.get(pieces, F.lit(1)), F.lit("")))
        return F.struct(F.coalesce(F.try_element_at(_names(), book), book).alias("book"), index.alias("index"), chapter.try_cast("int").alias("chapter"), verse.alias("verse"))

    def found(whole: Column) -> Column:
        rest = lambda name: F.substring(whole, F.length(name) + 1, F.length(whole))
        longest = F.get(F.filter(F.array(*map(F.lit, known)), lambda name: whole.startswith(name) & rest(name).rlike(r"\A[_.]?[0-9]")), F.lit(0))
        other = F.nullif(F.regexp_extract(whole, r"\A([0-9]*[A-Z]+)[_.]?[0-9]", 1), F.lit(""))
        return _let(F.coalesce(longest, other), lambda book: _let(F.ltrim(rest(book), F.lit("_.")), lambda index: made(book, index)))

    return _let(reference, found)


def parts(reference: Column) -> dict[str, Column]:
    whole = part(reference)
    return {c: whole[c] for c in ("book", "index", "chapter", "verse")}


def referenced(sentences: DataFrame, sent_id: Column) -> DataFrame:
    """Sentences (an array `words` with `misc`) that have a verse: refs, book, chapter, verse.

    References are the distinct values of `ref` attributes, sorted; only without any, the sentence id. The first
    counts for the order; sentences whose reference has no number after the book are left out. Texts that are not
    scripture but bear references are the caller's to filter. No shuffle.
    """
    misc = F.transform("words", lambda w: F.transform(F.filter(pairs(w["misc"]), lambda p: (F.lower(p["name"]) == "ref") & (p["value"] != "")), lambda p: p["value"]))
    rows = sentences.withColumn("_in", F.array_sort(F.array_distinct(F.flatten(misc))))
    rows = rows.withColumn("_all", F.when(F.size("_in") > 0, F.col("_in")).otherwise(F.array(reference_in_id(sent_id))))
    rows = rows.withColumn("_made", part(F.get("_all", F.lit(0)))).where(F.col("_made.index").rlike(r"\A[0-9]"))
    rows = rows.select("*", *(F.col(f"_made.{k}").alias(f"_{k}") for k in ("book", "index", "chapter", "verse")))
    refs = F.array_join(F.concat(F.array(F.concat_ws("_", "_book", "_index")), F.slice("_all", 2, F.greatest(F.size("_all"), F.lit(1)))), ",")
    return rows.select(*sentences.columns, refs.alias("refs"), F.col("_book").alias("book"), F.col("_chapter").alias("chapter"), F.col("_verse").alias("verse"))


def canonical(book: str = "book", chapter: str = "chapter", verse: str = "verse") -> list[Column]:
    """Sort columns: canonical order of the books, unknown books last, then chapter, then the verse's number."""
    place = F.array_position(F.array(*map(F.lit, BOOKS)), F.col(book))
    return [F.when(place == 0, len(BOOKS) + 1).otherwise(place), F.col(book), F.col(chapter), F.regexp_extract(verse, r"\A[0-9]{1,18}", 0).try_cast("bigint"), F.col(verse)]
