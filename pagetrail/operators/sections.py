"""Sections of documents as page intervals: ends, leaves, containment, widening, outline.

A section row has doc, seq (bookmark order), id, title, level, page_from, page_to and text. Pages meet intervals by
an index (see intervals), never by comparing all of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetrail.functions.text import outline_line, slug

from .intervals import marked, on_some_page, stabbed

MAX_LEVEL = 9
PART_PAGES = 4096
#: Fixed value: the title of a document that is a section as a whole.
WHOLE_TITLE = "Документ"


def _known_level(max_level: int) -> Column:
    """The level as a place in an array of max_level; a deeper one is an error, not a wrong page."""
    too_deep = F.raise_error(F.concat(F.lit(f"levels go to {max_level}: "), F.col("level").cast("string")))
    return F.when(F.col("level") <= max_level, F.col("level").cast("int")).otherwise(too_deep.cast("int"))


def section_ends(bookmarks: DataFrame, last_page: str = "last_page", max_level: int = MAX_LEVEL) -> DataFrame:
    """page_to is the page before the next bookmark of the same or a higher level, the last page without one.

    One window for each level instead of a self-join: the next page of level k or above, picked by the row's level. The window runs
    from the last bookmark back, where it grows by a row at each step; one that ends at the last row is summed up anew for each row.
    """
    after = Window.partitionBy("doc").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    nexts = [F.last(F.when(F.col("level") <= k, F.col("page_from")), ignorenulls=True).over(after) for k in range(1, max_level + 1)]
    following = F.element_at(F.array(*nexts), _known_level(max_level))
    return bookmarks.withColumn("page_to", F.when(following.isNotNull(), F.greatest(F.col("page_from"), following - 1)).otherwise(F.col(last_page)).cast("long"))


def with_ids(sections: DataFrame) -> DataFrame:
    """Ids from place and title."""
    return sections.withColumn("id", slug(F.col("seq"), F.col("title")))


def whole_documents(pages: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """(doc, seq, title, level, page_from, page_to) of the documents without a bookmark: each is one section."""
    rest = pages.groupBy("doc").agg(F.max("page").cast("long").alias("page_to")).join(bookmarks.select("doc").distinct(), "doc", "left_anti")
    return rest.select("doc", F.lit(1).cast("long").alias("seq"), F.lit(WHOLE_TITLE).alias("title"), F.lit(1).alias("level"), F.lit(1).cast("long").alias("page_from"), "page_to")


def section_pages(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, seq, page, text): every page of every section, a row each. Sections are opened into their pages, so a page's text moves once,
    to an equality join. Pages that are not there have no row."""
    opened = sections.filter("page_from <= page_to").select("doc", "seq", "page_from", F.explode(F.sequence(F.col("page_from").cast("long"), F.col("page_to").cast("long"))).alias("page"))
    return opened.join(pages.select("doc", F.col("page").cast("long").alias("page"), "text"), ["doc", "page"]).select("doc", "seq", "page_from", "page", "text")


def section_texts(sections: DataFrame, pages: DataFrame, part_pages: int = PART_PAGES) -> DataFrame:
    """(doc, seq, part, text): the texts of each section's pages in order, a line feed between them.

    part counts the pieces of part_pages pages (0 for all that are not longer), so that no group grows without bound. NULL texts are empty; of a
    page that is there twice both texts count, the smaller first; a section none of whose pages is there has no row."""
    rows = section_pages(sections, pages).withColumn("part", F.floor((F.col("page") - F.col("page_from")) / part_pages).cast("int"))
    own = F.struct("page", F.coalesce("text", F.lit("")).alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["text"]), "\n")
    return rows.groupBy("doc", "seq", "part").agg(text.alias("text"))


def build_sections(bookmarks: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections with ids and texts from bookmarks (doc, seq, title, level, page_from) and page texts (doc, page, text).

    A document without bookmarks is one section; the last page of a document is the last one with a text. A section of which no page is there has the text ''. A section longer
    than PART_PAGES pages has a row for each part."""
    last = pages.groupBy("doc").agg(F.max("page").cast("long").alias("last_page"))
    cut = section_ends(bookmarks.select("doc", F.col("seq").cast("long").alias("seq"), F.trim("title").alias("title"), F.col("level").cast("int").alias("level"), F.col("page_from").cast("long").alias("page_from")).join(last, "doc")).drop("last_page")
    all_ = with_ids(cut.unionByName(whole_documents(pages, bookmarks)))
    return all_.join(section_texts(all_, pages), ["doc", "seq"], "left").withColumns({"part": F.coalesce("part", F.lit(0)), "text": F.coalesce("text", F.lit(""))})


def leaf_sections(sections: DataFrame, max_level: int = MAX_LEVEL) -> DataFrame:
    """Sections in which no deeper section begins.

    One window instead of a self-join: the least start, from the section's own on, of a section below each level. It runs from the last
    page back, as in section_ends()."""
    on = Window.partitionBy("doc").orderBy(F.desc("page_from")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    starts = [F.min(F.when(F.col("level") > k, F.col("page_from"))).over(on) for k in range(1, max_level + 1)]
    rows = sections.withColumn("__deeper", F.element_at(F.array(*starts), _known_level(max_level)))
    return rows.filter(F.col("__deeper").isNull() | (F.col("__deeper") > F.col("page_to"))).drop("__deeper")


def drop_nested(sections: DataFrame) -> DataFrame:
    """Sections not inside another that is kept; of equal ranges the first stays.

    In the order of start and falling length a section is nested exactly if some earlier one ends no sooner.
    """
    w = Window.partitionBy("doc").orderBy("page_from", F.desc(F.col("page_to") - F.col("page_from")), "seq").rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("__reach", F.max("page_to").over(w)).filter(F.col("__reach").isNull() | (F.col("__reach") < F.col("page_to"))).drop("__reach")


def pick_sections(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """sections whose (doc, id) is wanted, in document order; unknown ids do nothing."""
    return sections.join(wanted, ["doc", "id"], "left_semi")


def facts_in_sections(facts: DataFrame, sections: DataFrame) -> DataFrame:
    """Facts on a page of some chosen section of their document; a NULL page is on none."""
    return on_some_page(facts, sections, ["doc"], "pg", "page_from", "page_to")


def facts_with_anchors(facts: DataFrame, sections: DataFrame, anchors: list[int]) -> DataFrame:
    """The facts on a page of some chosen section of their document (part 0), then those of the anchor pages that are not among them
    (part 1). Needs a key seq in each document; facts and sections are computed once."""
    rows = marked(facts, sections, ["doc"], ["seq"], "pg", "page_from", "page_to", "__chosen")
    part = F.when(F.col("__chosen"), 0).when(F.col("pg").isin(anchors), 1)
    return rows.withColumn("part", part).filter("part IS NOT NULL").drop("__chosen")


def parents(spans: DataFrame, sections: DataFrame) -> DataFrame:
    """(the columns of spans but lo and hi, id, seq): the top sections that contain a span (doc, lo, hi, ...), each once for equal rows."""
    tops = sections.filter("level = 1").select("doc", "id", "seq", "page_from", "page_to")
    held = stabbed(spans.distinct(), tops, ["doc"], "lo", "page_from", "page_to").filter("hi <= page_to")
    return held.drop("lo", "hi", "page_from", "page_to").distinct()


def widened(chosen: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, doc, id, rank): the chosen (*keys, doc, id, rank) in their order, then the top sections that contain one of them, in
    document order; no repeats. Ranks count from 1."""
    spans = chosen.join(sections.select("doc", "id", F.col("page_from").alias("lo"), F.col("page_to").alias("hi")), ["doc", "id"]).select(*keys, "doc", "lo", "hi")
    place = lambda part, c: F.struct(F.lit(part).alias("part"), F.col(c).cast("long").alias("place")).alias("at")
    both = chosen.select(*keys, "doc", "id", place(0, "rank")).union(parents(spans, sections).select(*keys, "doc", "id", place(1, "seq")))
    first = both.groupBy(*keys, "doc", "id").agg(F.min("at").alias("at"))
    return first.select(*keys, "doc", "id", F.row_number().over(Window.partitionBy(*keys, *([] if keys else ["doc"])).orderBy("at", "doc")).alias("rank"))


def widen_to_parents(sections: DataFrame, chosen: DataFrame) -> DataFrame:
    """widened() for a choice (doc, id, rank) of each document."""
    return widened(chosen, sections, []).select("doc", "id", "rank")


def outline(sections: DataFrame, max_level: int = 4) -> DataFrame:
    """One outline text a document."""
    line = outline_line(F.col("id"), F.col("title"), F.col("level"), F.col("page_from"), F.col("page_to"))
    rows = sections.filter(F.col("level") <= max_level).select("doc", F.struct("seq", line.alias("line")).alias("x"))
    lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])
    return rows.groupBy("doc").agg(F.array_join(lines, "\n").alias("outline"))
