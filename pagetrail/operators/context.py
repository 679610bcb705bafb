"""Routing decisions, contexts and guarded answers as one lazy plan around a pluggable model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetrail.functions import text as X
from pagetrail.shared import written

from . import evaluate
from . import intervals as I
from . import sections as S
from .models import Answerer, call_model, call_model_about

NOTICE = "Это сведения из документа, а не инвестиционная рекомендация."
WARNING = "Внимание: ответ похож на рекомендацию к действию."


def route(replies: DataFrame, known: DataFrame, least_confidence: float = 0.6) -> DataFrame:
    """(question_id, ids, confidence, need_full, widen) from router replies (question_id, reply, and the question's doc).

    Unknown ids go, and so do those of another document where both sides name it; a reply that is no JSON object, or that names no known id, asks for the full document; confidence under
    the limit asks to widen the choice to the parents."""
    v = replies.withColumn("v", X.repair_json(F.col("reply")))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    rows = v.select("question_id", *[c for c in ("doc",) if c in replies.columns], get("$.sections", "array<string>").alias("named"), F.coalesce(get("$.confidence", "double"), F.lit(0.0)).alias("confidence"), F.coalesce(get("$.need_full", "boolean"), F.lit(False)).alias("need_full"))
    on = ["doc", "id"] if "doc" in replies.columns and "doc" in known.columns else ["id"]
    named = rows.select("question_id", *on[:-1], F.posexplode("named").alias("rank", "id")).join(known.select(*on).distinct(), on)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    out = rows.join(named.groupBy("question_id").agg(ids.alias("ids")), "question_id", "left")
    full = F.col("need_full") | F.col("ids").isNull()
    return out.select("question_id", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), "confidence", full.alias("need_full"), (~full & (F.col("confidence") < least_confidence)).alias("widen"))


def choose(decisions: DataFrame, questions: DataFrame, sections: DataFrame) -> DataFrame:
    """R7, J5 applied: (question_id, id, rank) for build(): the ids of each decision in their order, then, where it asks to widen, the
    top sections that contain one of them; no repeats. A question that needs the full document gets no row."""
    own = decisions.filter("NOT need_full").join(questions.select("question_id", "doc"), "question_id").select("question_id", "doc", "widen", F.posexplode("ids").alias("rank", "id"))
    plain, wide = own.filter("NOT widen"), own.filter("widen")
    first = plain.groupBy("question_id", "id").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("question_id").orderBy("rank")
    return first.select("question_id", "id", F.row_number().over(order).alias("rank")).union(S.widened(wide.drop("widen"), sections, ["question_id"]).select("question_id", "id", "rank"))


FACT = ("t", "m", "s", "p", "v", "u", "pg")


#: A document's text goes to so many places, by question, so that the prompts of its questions are put together by that many tasks.
SPREAD = 32


def _with_document(questions: DataFrame, documents: DataFrame, how: str = "inner") -> DataFrame:
    """questions with the columns of their document (doc, ...), a row a document, which may be long: it is copied SPREAD times, never once a question, and a question's row
    grows only where its prompt is put together."""
    asked, copies = _spread(questions, documents)
    return asked.join(copies.hint("merge"), ["doc", "__at"], how).drop("__at")


def _spread(questions: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the key (doc, __at): each question at one of SPREAD places, each document at all of them."""
    at = F.pmod(F.xxhash64("question_id"), F.lit(SPREAD)).cast("int")
    return questions.withColumn("__at", at), documents.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))


def _facts_of(docs: DataFrame, kept: DataFrame, facts: DataFrame, anchors: list[int]) -> DataFrame:
    """(question_id, part, seq, FACT): the facts of each question (question_id, doc), each once; those of anchor pages only come last (part 1)."""
    spans = I.disjoint(kept, ["question_id", "doc"], "page_from", "page_to")
    own = I.stabbed(facts, spans, ["doc"], "pg", "page_from", "page_to").drop("page_from", "page_to").withColumn("part", F.lit(0))
    anchored = facts.filter(F.col("pg").isin(anchors)).join(docs, "doc").join(own.select("question_id", "seq"), ["question_id", "seq"], "left_anti").withColumn("part", F.lit(1))
    cols = ["question_id", "part", "seq", *FACT]
    return own.select(*cols).unionByName(anchored.select(*cols))


def build(questions: DataFrame, sections: DataFrame, facts: DataFrame, chosen: DataFrame, anchors: list[int], aggregates: DataFrame | None = None, values: bool = False) -> DataFrame:
    """question_id, mode, prompt, pages, chars for questions (question_id, question, doc, mode).

    chosen: question_id, id. Mode full takes the top sections; a choice that finds nothing falls back to them and is labelled
    so. Of a choice, sections inside another chosen one go; of the top sections none. Facts are all of the document in mode full, else those on the pages of
    the sections that were taken (in the fallback too, so a fact without a page is in mode full only), then those of the anchor pages. aggregates (doc, aggregates as JSON) go with every prompt of their document.
    values: also the prompt's numbers (there), those of a whole document read once."""
    some, full, whole = _contexts(questions, sections, facts, chosen, anchors, aggregates, values)
    full = _with_document(full, whole).withColumn("numbers", F.when(F.col("mode") == "full", F.col("every")).otherwise(F.col("numbers"))).drop("every")

    def prompts(rows: DataFrame, once: bool) -> DataFrame:
        json = _json(aggregates)
        rows = rows.withColumn("prompt", X.prompt(F.col("question"), json, F.col("document")))
        # tags part question, numbers and document, so no number or page reference crosses them
        more = [] if not values else [F.concat("there", X.values_in(X.prompt(F.col("question"), json, F.lit("")) if once else F.col("prompt"))).alias("there")]
        return rows.select("question_id", "question", "mode", "prompt", "pages", F.length("prompt").alias("chars"), X.token_estimate(F.col("prompt")).alias("tokens"), *more)

    return prompts(some, False).unionByName(prompts(full, True))


def _json(aggregates: DataFrame | None) -> Column:
    return X.numbers_json(F.col("numbers"), None if aggregates is None else F.col("aggregates"))


def _contexts(questions: DataFrame, sections: DataFrame, facts: DataFrame, chosen: DataFrame, anchors: list[int], aggregates: DataFrame | None, values: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What prompts are put together from: questions with their own document and numbers; those that take a whole document, with numbers where these are not all of the document's;
    the documents (document, pages, every: all facts), written."""
    q = questions.select("question_id", "question", "doc", "mode")
    top = sections.filter("level = 1")
    own = lambda s: s.withColumn("d", F.col("doc")).withColumn("doc", F.concat_ws("\u0001", "doc", F.col("question_id").cast("string")))
    picked = S.drop_nested(own(q.filter("mode <> 'full'").join(chosen.distinct(), "question_id").join(sections, ["doc", "id"]))).withColumn("doc", F.col("d")).drop("d")
    empty = q.filter("mode <> 'full'").join(picked.select("question_id").distinct(), "question_id", "left_anti").withColumn("mode", F.concat("mode", F.lit("->full")))
    cols = ["question_id", "question", "doc", "mode", "seq", "id", "title", "level", "page_from", "page_to", "text"]
    xml = F.struct("seq", X.section_xml(F.col("id"), F.col("title"), F.col("page_from"), F.col("page_to"), F.col("text")).alias("x"))
    document = F.array_join(F.transform(F.array_sort(F.collect_list(xml)), lambda s: s["x"]), "\n\n")
    ends = F.array_sort(F.array_distinct(F.concat(F.collect_set(F.col("page_from").cast("long")), F.collect_set(F.col("page_to").cast("long")))))
    fact = F.struct("part", "seq", F.struct(*FACT).alias("x"))
    numbers = X.facts_json(F.transform(F.array_sort(F.collect_list(fact)), lambda z: z["x"]))
    facts = facts.filter("v IS NOT NULL").select("doc", "seq", *FACT)
    # top sections and all facts are the same for every question of a document: put together once a document
    whole = top.groupBy("doc").agg(document.alias("document"), ends.alias("pages"))
    if values:
        whole = whole.withColumn("there", F.array_distinct(X.values_in(F.col("document"))))
    if aggregates is not None:
        whole = whole.join(aggregates.select("doc", "aggregates"), "doc", "left")
    of_doc = facts.withColumn("part", F.lit(0)).groupBy("doc").agg(numbers.alias("every"))
    whole = written(whole.join(of_doc, "doc", "left"), "whole")
    per = _facts_of(picked.select("question_id", "doc").unionByName(empty.select("question_id", "doc")).distinct(), picked.select("question_id", "doc", "page_from", "page_to").unionByName(empty.join(top, "doc").select("question_id", "doc", "page_from", "page_to")), facts, anchors)
    per = per.groupBy("question_id").agg(numbers.alias("numbers"))
    some = picked.select(*cols).groupBy("question_id", "question", "doc", "mode").agg(document.alias("document"), ends.alias("pages")).join(per, "question_id", "left")
    if values:
        some = some.withColumn("there", F.array().cast("array<double>"))
    if aggregates is not None:
        some = some.join(aggregates.select("doc", "aggregates"), "doc", "left")
    full = q.filter("mode = 'full'").withColumn("numbers", F.lit(None).cast("string")).unionByName(empty.join(per, "question_id", "left"))
    return some, full, whole


def guard(answers: DataFrame) -> DataFrame:
    """Flags (advice_guarded: advice was asked for, or a verdict given), decorated text, unverified numbers of the raw text, pages cited in the decorated one."""
    advice, verdict = X.is_advice_request(F.col("question")), X.has_verdict(F.col("text"))
    rows = answers if "unverified" in answers.columns else answers.withColumn("unverified", evaluate.unverified(F.col("text"), F.col("prompt")))
    rows = rows.withColumn("advice_guarded", advice | verdict).withColumn("verdict_leaked", verdict)
    rows = rows.withColumn("text", X.guarded(F.col("text"), F.col("advice_guarded"), F.col("verdict_leaked"), NOTICE, WARNING))
    return rows.withColumn("cited_pages", X.citations(F.col("text"))).withColumn("has_citations", F.size("cited_pages") > 0)


def answer(questions: DataFrame, sections: DataFrame, facts: DataFrame, chosen: DataFrame, answerer: Answerer, anchors: list[int], aggregates: DataFrame | None = None, **options) -> DataFrame:
    """Contexts with the documents' aggregates (S9, R8), model, guards. options go to the calls."""
    return guard(call_model(build(questions, sections, facts, chosen, anchors, aggregates), answerer, **options))


#: What the router is told before outline and question.
ROUTER_TASK = "Выбери разделы, в которых есть ответ. Верни JSON {\"sections\": [id, ...], \"confidence\": 0..1, \"need_full\": bool}."


def router_prompts(questions: DataFrame, sections: DataFrame, max_level: int = 4) -> DataFrame:
    """(question_id, question, doc, mode, prompt) of the questions in mode router: task, the document's outline, question. A document without
    sections of these levels has an empty outline."""
    q = _with_document(questions.filter("mode = 'router'"), written(S.outline(sections, max_level), "outline"), "left")
    text = F.concat(F.lit(ROUTER_TASK + "\n\n<outline>\n"), F.coalesce("outline", F.lit("")), F.lit("\n</outline>\n\n<question>"), F.coalesce("question", F.lit("")), F.lit("</question>"))
    return q.select("question_id", "question", "doc", "mode", text.alias("prompt"))


def routed(questions: DataFrame, sections: DataFrame, router: Answerer, max_level: int = 4, **options) -> DataFrame:
    """(question_id, question, doc, mode, the reply's columns) of the questions in mode router: the calls of router_prompts(), whose prompts exist only while their calls are
    made. Written, so that each call is made once."""
    q, outlines = _spread(questions.filter("mode = 'router'").select("question_id", "question", "doc", "mode"), written(S.outline(sections, max_level), "outline"))

    def prompt(row: dict, document: dict | None) -> str:
        return f"{ROUTER_TASK}\n\n<outline>\n{(document or {}).get('outline') or ''}\n</outline>\n\n<question>{row['question'] or ''}</question>"

    return written(call_model_about(q, outlines, ["doc", "__at"], prompt, router, **options).drop("__at", "chars"), "routed")


def _answers(questions: DataFrame, sections: DataFrame, facts: DataFrame, chosen: DataFrame, anchors: list[int], aggregates: DataFrame | None, answerer: Answerer, **options) -> DataFrame:
    """The columns of build() but prompt, the reply's and unverified. Prompts of a whole document exist only while their calls are made; the replies are written."""
    some, full, whole = _contexts(questions, sections, facts, chosen, anchors, aggregates, True)
    json, text = _json(aggregates), X.prompt(F.col("question"), F.col("json"), F.col("document"))
    some = some.withColumn("json", json).withColumn("prompt", text).withColumns({"chars": F.length("prompt"), "there": F.concat("there", X.values_in(F.col("prompt")))})
    kept = ["question_id", "question", "mode", "pages", "chars"]
    own = call_model(some.select(*kept, "there", "prompt"), answerer, **options).withColumn("unverified", evaluate.unverified_among(F.col("text"), F.col("there")))
    own = written(own.drop("there", "prompt"), "answers")
    # the numbers of all facts are a document's, those of a choice a question's
    every = whole.select("doc", F.col("every").alias("numbers"), *(["aggregates"] if aggregates is not None else []))
    documents = whole.select("doc", "document").join(every.select("doc", json.alias("every")), "doc")
    more = full.filter("mode <> 'full'").join(every.drop("numbers"), "doc", "left").withColumn("json", json).select("question_id", "question", "doc", "mode", "json")
    asked, copies = _spread(full.filter("mode = 'full'").withColumn("json", F.lit(None).cast("string")).select("question_id", "question", "doc", "mode", "json").unionByName(more), documents)
    asked = asked.join(F.broadcast(whole.select("doc")), "doc", "left_semi")

    def prompt(row: dict, document: dict | None) -> str | None:
        parts = (row["question"], document["every"] if row["json"] is None else row["json"], document["document"])
        return None if None in parts else "<question>{}</question>\n\n<numbers>\n{}\n</numbers>\n\n<document>\n{}\n</document>".format(*parts)

    replies = written(call_model_about(asked, copies, ["doc", "__at"], prompt, answerer, **options).drop("__at"), "answers")
    there = _with_document(replies, whole.select("doc", "pages", "there").join(documents.select("doc", "every"), "doc"))
    there = there.withColumn("there", F.concat("there", X.values_in(X.prompt(F.col("question"), F.coalesce("json", "every"), F.lit("")))))
    there = there.withColumn("unverified", evaluate.unverified_among(F.col("text"), F.col("there")))
    both = own.unionByName(there.select(*own.columns))
    return both.withColumn("tokens", F.floor(F.col("chars") / 2.5).cast("int"))


def selected(questions: DataFrame, sections: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, chosen) for build() from the router's replies (question_id, doc, reply): a question that needs the full document
    goes there in mode full; so does one whose router call failed (reply NULL). Decisions are written, as several parts of the context's plan read them."""
    decisions = written(route(replies, sections), "decisions")
    need = decisions.select("question_id", "need_full")
    q = questions.join(need, "question_id", "left").withColumn("mode", F.when(F.coalesce("need_full", F.lit(False)), "full").otherwise(F.col("mode")))
    return q.select("question_id", "question", "doc", "mode"), written(choose(decisions, questions, sections), "chosen")


def ask(questions: DataFrame, sections: DataFrame, facts: DataFrame, router: Answerer, answerer: Answerer, anchors: list[int], aggregates: DataFrame | None = None, searched: DataFrame | None = None, prices: DataFrame | None = None, keep_prompts: bool = True, **options) -> DataFrame:
    """Entry point, from questions (question_id, question, doc, mode) to guarded answers: in mode router the router's prompt, call and decision, widened where
    it is unsure; in mode vector the sections found by search (searched: question_id, id); then context with facts and aggregates, model call, guards and cost.

    The router's tokens and time count with the answer's. prices: model, price_in, price_out. The replies are written before they are used,
    so that each call is made once (options: see call_model). The router's prompts are not written; with keep_prompts=False neither are the others, which hold
    a whole document for some questions: the answers' numbers are compared before."""
    first = routed(questions, sections, router, **options)
    q, chosen = selected(questions, sections, first.select("question_id", "doc", F.col("text").alias("reply")))
    if searched is not None:
        chosen = chosen.select("question_id", "id").unionByName(questions.filter("mode = 'vector'").select("question_id").join(searched, "question_id").select("question_id", "id"))
    parts = (q, sections, facts, chosen.select("question_id", "id"), anchors, aggregates)
    if keep_prompts:
        replies = call_model(build(*parts, values=True), answerer, **options).withColumn("unverified", evaluate.unverified_among(F.col("text"), F.col("there")))
        out = guard(written(replies.drop("there"), "answers"))
    else:
        out = guard(written(_answers(*parts, answerer, **options), "answers"))
    spent = first.select("question_id", *[F.col(c).alias(f"router_{c}") for c in ("prompt_tokens", "completion_tokens", "latency_s")])
    out = out.join(spent, "question_id", "left")
    if prices is not None:
        out = evaluate.with_cost(out, prices)
    both = lambda c: F.col(c) + F.coalesce(f"router_{c}", F.lit(0))
    return out.withColumns({c: both(c) for c in ("prompt_tokens", "completion_tokens", "latency_s")}).drop("router_prompt_tokens", "router_completion_tokens", "router_latency_s")
