"""Text, token, citation and guard functions as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _translate(s: Column, chars: str, to: str) -> Column:
    return F.translate(s, chars, to * len(chars))


def norm_text(s: Column) -> Column:
    """Lower case, ё as е, marks and dashes as spaces, single spaces; '' for NULL."""
    t = F.replace(_translate(F.lower(s.cast("string")), P.TEXT_SPACES, " "), F.lit("ё"), F.lit("е"))
    t = _translate(t, "«»\"'`().,:;*-–—", " ")
    return F.coalesce(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def canon_metric(metric: Column) -> Column:
    """struct(name, is_change, rest): the first canonical name that fits, else the text without change words."""
    t = norm_text(metric)
    change = "(?U)" + P.CHANGE_WORDS
    rest = F.trim(F.regexp_replace(F.regexp_replace(t, change, " "), r"\s+", " "))
    name = reduce(lambda e, p: e.when(rest.rlike("(?U)" + p[0]), p[1]), P.CANONICAL_METRICS[1:], F.when(rest.rlike("(?U)" + P.CANONICAL_METRICS[0][0]), P.CANONICAL_METRICS[0][1]))
    return F.struct(name.otherwise(rest).alias("name"), t.rlike(change).alias("is_change"), rest.alias("rest"))


def token_set(s: Column) -> Column:
    """Distinct normalised words of more than two characters."""
    return F.array_distinct(F.filter(F.split(norm_text(s), " "), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """T4: 0 if either set is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def split_metric(metric: Column, segment: Column) -> Column:
    """T5: struct(m, s): a short tail after a spaced dash is the segment of a record that has none."""
    parts = F.split(metric, r"\s+[—–-]\s+")
    tail = F.trim(parts[1])
    split = (F.coalesce(segment, F.lit("")) == "") & (F.coalesce(metric, F.lit("")) != "") & (F.size(parts) == 2)
    split = split & (F.size(F.filter(F.split(tail, r"\s+"), lambda w: w != "")) <= 4)
    return F.when(split, F.struct(F.trim(parts[0]).alias("m"), tail.alias("s"))).otherwise(F.struct(metric.alias("m"), segment.alias("s")))


def slug(index: Column, title: Column) -> Column:
    """s007-lower-case-title, 40 characters of it."""
    t = F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_]+", "-"), F.lit("-"))
    return F.concat(F.lit("s"), F.lpad(index.cast("string"), 3, "0"), F.lit("-"), F.substring(t, 1, 40))


def tokens(s: Column) -> Column:
    """Lower-case words with hyphens, repeats kept."""
    return F.transform(F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(f"({P.TOKEN})"), F.lit(1)), F.lower)


def values_in(s: Column) -> Column:
    """The numbers of a text in order, without years and page references; repeats kept."""
    text = F.regexp_replace(F.coalesce(s, F.lit("")), "(?iu)" + P.PAGE_REFERENCE, " ")
    raw = F.regexp_extract_all(text, F.lit(f"({P.ANSWER_NUMBER})"), F.lit(1))
    plain = F.transform(raw, lambda x: F.replace(_drop(x, P.ANSWER_SPACES), F.lit(","), F.lit(".")))
    return F.transform(F.filter(plain, lambda x: ~x.rlike(P.YEAR)), lambda x: x.try_cast("double"))


def _drop(s: Column, chars: str) -> Column:
    return F.translate(s, chars, "")


def number_text(v: Column) -> Column:
    """Three decimals without trailing zeros; numbers beyond 35 digits as they print."""
    plain = F.round(v, 3).try_cast("decimal(38,3)").cast("string")
    return F.coalesce(F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", ""), v.cast("string"))


def numbers_in(s: Column) -> Column:
    """The set of a text's numbers in one spelling."""
    return F.array_distinct(F.transform(values_in(s), number_text))


def decimals(v: Column) -> Column:
    """Decimals of a double's shortest spelling, one at least; what lies beyond the sixth does not count."""
    plain = F.abs(v).try_cast("decimal(38,6)").cast("string")
    return F.greatest(F.lit(1), F.coalesce(F.length(F.regexp_replace(F.regexp_extract(plain, r"\.([0-9]+)$", 1), "0+$", "")), F.lit(1)))


def citations(s: Column) -> Column:
    """Cited pages, distinct and sorted; of a range the first page."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit("(?iu)" + P.CITED_PAGE), F.lit(1)), lambda x: x.cast("int"))))


def is_advice_request(s: Column) -> Column:
    """Does a question ask for investment advice?"""
    return F.coalesce(s.rlike("(?iuU)" + "|".join(P.ADVICE)), F.lit(False))


def has_verdict(s: Column) -> Column:
    """Does an answer recommend to act? A negated recommendation does not."""
    return F.coalesce(s.rlike("(?iuU)" + "|".join(P.VERDICTS)), F.lit(False))


def repair_json(s: Column) -> Column:
    """The JSON of a model's reply as VARIANT: fenced, else whole, else the widest [..], then {..}; else NULL."""
    fence = r"(?s)```(?:json)?\s*(.*?)\s*```"
    body = F.when(s.rlike(fence), F.regexp_extract(s, fence, 1)).otherwise(F.trim(s))
    cut = [F.nullif(F.regexp_extract(body, rf"(?s)({a}.*{b})", 1), F.lit("")) for a, b in ((r"\[", r"\]"), (r"\{", r"\}"))]
    return F.coalesce(F.try_parse_json(body), *[F.try_parse_json(c) for c in cut])


def contains_all(s: Column, terms: Column) -> Column:
    """Every term occurs, case ignored."""
    return F.forall(terms, lambda t: F.contains(F.lower(s), F.lower(t)))


def contains_which(s: Column, terms: Column) -> Column:
    """The terms that occur, case ignored."""
    return F.filter(terms, lambda t: F.contains(F.lower(s), F.lower(t)))


def admits_missing(s: Column) -> Column:
    """Does an answer say that the data are not there?"""
    return F.exists(F.array(*map(F.lit, P.REFUSALS)), lambda t: F.contains(F.lower(s), t))


def section_xml(section_id: Column, title: Column, page_from: Column, page_to: Column, text: Column) -> Column:
    """A section in a tag, its text as it is."""
    pages = F.concat_ws("-", page_from.cast("string"), page_to.cast("string"))
    return F.concat(F.lit('<section id="'), section_id, F.lit('" title="'), title, F.lit('" pages="'), pages, F.lit('">\n'), text, F.lit("\n</section>"))


def facts_json(facts: Column) -> Column:
    """An array of fact structs as compact JSON, explicit nulls kept."""
    return F.to_json(facts, {"ignoreNullFields": "false"})


def numbers_json(facts: Column, aggregates: Column | None = None) -> Column:
    """The facts' JSON array, and the aggregates' JSON if there is one, as one compact object."""
    more = F.lit("") if aggregates is None else F.coalesce(F.concat(F.lit(',"aggregates":'), aggregates), F.lit(""))
    return F.concat(F.lit('{"numbers":'), F.coalesce(facts, F.lit("[]")), more, F.lit("}"))


def prompt(question: Column, numbers: Column, document: Column) -> Column:
    """Question, numbers and document, each in its tag."""
    return F.concat(F.lit("<question>"), question, F.lit("</question>\n\n<numbers>\n"), numbers, F.lit("\n</numbers>\n\n<document>\n"), document, F.lit("\n</document>"))


def outline_line(section_id: Column, title: Column, level: Column, page_from: Column, page_to: Column) -> Column:
    """Indented `id | title | стр. a-b`."""
    return F.concat(F.repeat(F.lit("  "), level - 1), section_id, F.lit(" | "), title, F.lit(" | стр. "), page_from.cast("string"), F.lit("-"), page_to.cast("string"))


def searchable(title: Column, page_from: Column, page_to: Column, text: Column) -> Column:
    """Title, pages and text of a chunk."""
    return F.concat_ws("\n", title, F.concat(F.lit("стр. "), page_from.cast("string"), F.lit("-"), page_to.cast("string")), text)


def token_estimate(s: Column) -> Column:
    """Characters by 2.5, cut to a whole number."""
    return F.floor(F.length(s) / 2.5).cast("int")


def call_cost(prompt_tokens: Column, completion_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """US dollars at prices per million tokens; an unknown price is 0."""
    return (prompt_tokens * F.coalesce(price_in, F.lit(0.0)) + completion_tokens * F.coalesce(price_out, F.lit(0.0))) / 1e6


def number_density(s: Column) -> Column:
    """How many printed numbers a page holds."""
    return F.regexp_count(s, F.lit(r"[0-9][0-9 ]*(?:[.,][0-9]+)?"))


def page_list(s: Column) -> Column:
    """T25: '21 86 90-96' as page numbers."""
    parts = F.filter(F.split(F.trim(s), r"\s+"), lambda x: x != "")
    return F.flatten(F.transform(parts, lambda x: F.sequence(F.split(x, "-")[0].cast("int"), F.element_at(F.split(x, "-"), -1).cast("int"))))


def rgb(colour: Column) -> Column:
    """Red, green and blue of a packed colour."""
    return F.array(*[F.shiftright(colour, k).bitwiseAND(255).cast("int") for k in (16, 8, 0)])


def colours_close(a: Column, b: Column, tolerance: int = 12) -> Column:
    """Every channel within the tolerance."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= tolerance)


def guarded(text: Column, advice: Column, verdict: Column, notice: str, warning: str) -> Column:
    """The answer with a warning before a verdict, and a notice after either a request for advice or a verdict."""
    return F.concat(F.when(verdict, warning + "\n\n").otherwise(""), text, F.when(advice | verdict, "\n\n" + notice).otherwise(""))


def folded(items: Column, start: Column, step, last) -> Column:
    """The pieces that a fold over an array gives out, as an array: linear in the items, where appending to the result at each step would copy it each time.

    step(cur, item) gives a struct of out, an array of what is given out (mostly none or one), and cur, the state after the item; last(cur) gives
    an array of what is given out at the end. Items are folded in blocks of about the square root of their number, so what is copied
    at each step is a block's result, and the whole result once a block."""
    none = F.slice(last(start), 1, 0)

    def put(acc: Column, x: Column) -> Column:
        return let(step(acc["cur"], x), lambda r: F.struct(F.when(F.size(r["out"]) > 0, F.concat(acc["out"], r["out"])).otherwise(acc["out"]).alias("out"), r["cur"].alias("cur")))

    def block(acc: Column, xs: Column) -> Column:
        return let(F.aggregate(xs, F.struct(none.alias("out"), acc["cur"].alias("cur")), put), lambda r: F.struct(F.concat(acc["out"], r["out"]).alias("out"), r["cur"].alias("cur")))

    def whole(xs: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(1))
        blocks = F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda k: F.slice(xs, k * width + 1, width)))
        return F.aggregate(F.coalesce(blocks, F.slice(F.array(xs), 1, 0)), F.struct(none.alias("out"), start.alias("cur")), block, lambda acc: F.concat(acc["out"], last(acc["cur"])))

    return let(items, whole)
