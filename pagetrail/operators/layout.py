"""Positioned words and rectangles of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetrail.functions.numbers import is_value, norm_num
from pagetrail.functions.text import colours_close, folded, let, rgb


def reading_order(digits: int = 1) -> list[Column]:
    """Lines from the top, words from the left."""
    return [F.round("y0", digits), F.col("x0")]


def merge_adjacent(words: DataFrame, gap: float = 3.2, line: float = 1.2) -> DataFrame:
    """Words of a page in reading order, joined to the piece before while they begin 0..gap after its right edge
    and within ``line`` of its first word's height. A fold over the page's words, as each step looks at what was joined,
    linear in their number."""
    piece = "struct<x0:double,y0:double,x1:double,y1:double,text:string>"
    read = F.array_sort(F.collect_list(F.struct(F.round("y0", 1).alias("r"), "x0", "word", "text", "y0", "x1", "y1")))

    def shape(x0, y0, x1, y1, text):
        return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), text.alias("text"))

    def step(cur, w):
        dx = w["x0"] - cur["x1"]
        joins = F.coalesce((F.abs(w["y0"] - cur["y0"]) < line) & (dx >= 0) & (dx < gap), F.lit(False))
        longer = shape(cur["x0"], cur["y0"], F.greatest(cur["x1"], w["x1"]), F.greatest(cur["y1"], w["y1"]), F.concat(cur["text"], w["text"]))
        done = F.when(joins | cur.isNull(), none).otherwise(F.array(cur))
        return F.struct(done.alias("out"), F.when(joins, longer).otherwise(shape(w["x0"], w["y0"], w["x1"], w["y1"], w["text"])).alias("cur"))

    none = F.array().cast(f"array<{piece}>")
    pieces = folded(F.col("words"), F.lit(None).cast(piece), step, lambda cur: F.when(cur.isNull(), none).otherwise(F.array(cur)))
    return words.groupBy("page").agg(read.alias("words")).select("page", F.explode(pieces).alias("p")).select("page", "p.*")


def in_band(words: DataFrame, y_lo: float, y_hi: float, x_lo: float, x_hi: float, exclude: list[str] = (), allow_pct: bool = False) -> DataFrame:
    """value labels inside a rectangle of the page, less the excluded texts."""
    rows = words.filter(F.col("y0").between(y_lo, y_hi) & F.col("x0").between(x_lo, x_hi) & is_value(F.col("text"), allow_pct))
    return rows.filter(~F.col("text").isin(list(exclude))) if exclude else rows


def band_sequence(words: DataFrame, y_lo: float, y_hi: float, n: int, by: str = "y", x_lo: float = -1e9, x_hi: float = 1e9, exclude: list[str] = (), allow_pct: bool = True) -> DataFrame:
    """Q5: (page, place, text, value, found, ok): the value labels of a band in order, which is that of reading ("y"), from the left
    ("x") or of the file ("stream", by word); ties by text. found counts the page's labels; ok says whether there are n of them."""
    order = {"y": reading_order(), "x": [F.col("x0")], "stream": []}[by]
    page = Window.partitionBy("page")
    rows = in_band(words, y_lo, y_hi, x_lo, x_hi, exclude, allow_pct).withColumn("place", F.row_number().over(page.orderBy(*order, "word", "text"))).withColumn("found", F.count(F.lit(1)).over(page))
    return rows.select("page", "place", "text", norm_num(F.col("text")).alias("value"), "found", (F.col("found") == n).alias("ok"))


def label_lines(lines: DataFrame, value: str, stops: list[str]) -> DataFrame:
    """(doc, line, value, label) of the lines (doc, line, text) that fit the pattern, whose first group is the value.

    The label is the two lines before, blank ones skipped; it ends where a line holds one of the stops, and begins with a line
    that ends in a colon. Colons and digits at its end go. Without such lines it is empty."""
    text = F.trim("text")
    by_line = Window.partitionBy("doc").orderBy("line")
    rows = lines.select("doc", "line", text.alias("t")).filter("t <> ''").withColumn("one", F.lag("t", 1).over(by_line)).withColumn("two", F.lag("t", 2).over(by_line)).filter(F.col("t").rlike(value))
    ends = lambda c: F.col(c).isNull() | F.exists(F.array(*map(F.lit, stops)), lambda s: F.contains(F.col(c), s))
    label = F.when(ends("one"), "").when(F.endswith("one", F.lit(":")) | ends("two"), F.col("one")).otherwise(F.concat_ws(" ", "two", "one"))
    label = F.trim(F.regexp_replace(F.trim(F.rtrim(label, F.lit(":"))), "[0-9]+$", ""))
    return rows.select("doc", "line", F.regexp_extract("t", value, 1).alias("value"), label.alias("label"))


def assert_count(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """groups with their size and whether it is the expected one."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("found")).withColumn("ok", F.col("found") == n)


def nearest(ticks: DataFrame, numbers: DataFrame, most: float = 22.0) -> DataFrame:
    """J12 without the one-use rule: the number nearest to each tick on its page, by horizontal distance, then position."""
    t, n = ticks.alias("t"), numbers.alias("n")
    rows = t.join(n, (F.col("t.page") == F.col("n.page")) & (F.abs(F.col("t.x") - F.col("n.x")) <= most))
    dx = F.abs(F.col("t.x") - F.col("n.x"))
    return rows.groupBy(F.col("t.page").alias("page"), F.col("t.tick").alias("tick")).agg(F.min(F.struct(dx.alias("dx"), F.col("n.x").alias("nx"), F.col("n.value").alias("value"))).alias("b")).select("page", "tick", F.round("b.dx", 4).alias("dx"), "b.value")


def assign_ticks(ticks: DataFrame, numbers: DataFrame, most: float = 22.0) -> DataFrame:
    """Ticks from the left take the nearest number that is still free; one too far away takes none.

    A fold over the page's ticks in a higher-order function: pages are small and independent."""
    t = ticks.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("tick").cast("long").alias("tick")))).alias("ticks"))
    n = numbers.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("value").cast("double").alias("value")))).alias("free"))
    start = F.struct(F.transform("free", lambda v, i: F.struct(i.alias("i"), v["x"].alias("x"), v["value"].alias("value"))).alias("free"), F.array().cast("array<struct<tick:bigint,value:double>>").alias("out"))

    def step(acc, tick):
        near = F.array_min(F.transform(acc["free"], lambda v: F.struct(F.abs(v["x"] - tick["x"]).alias("d"), v["i"].alias("i"), v["value"].alias("value"))))
        take = lambda best: F.when(best["d"] <= most, F.struct(F.filter(acc["free"], lambda v: v["i"] != best["i"]).alias("free"), F.concat(acc["out"], F.array(F.struct(tick["tick"].alias("tick"), best["value"].alias("value")))).alias("out"))).otherwise(acc)
        return F.coalesce(let(near, take), acc)

    return t.join(n, "page").select("page", F.explode(F.aggregate("ticks", start, step)["out"]).alias("o")).select("page", "o.tick", "o.value")


def tick_chart(ticks: DataFrame, numbers: DataFrame, expected: int | None = None, most: float = 22.0) -> DataFrame:
    """(page, tick, value, dx, status, n_ticks) for every tick: assign_ticks() with what was not filled and why.

    status: ok; none_free (no number of the page is left for it); too_far (the nearest free one is farther than most: value NULL, its distance in dx); no_place (the
    tick's x is NULL); and, for all ticks of a page that has not the expected number of them, tick_count, as their labels would be wrong: no value then.
    A tick may stand twice; each takes a number of its own."""
    t = ticks.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("tick").cast("long").alias("tick")))).alias("ticks"))
    own = F.struct(F.col("x").cast("double").alias("x"), F.col("value").cast("double").alias("value"))
    n = numbers.filter("x IS NOT NULL").groupBy(F.col("page").alias("of")).agg(F.array_sort(F.collect_list(own)).alias("free"))
    kind = "struct<tick:bigint,value:double,dx:double,status:string>"
    free = F.coalesce(F.transform("free", lambda v, i: F.struct(i.alias("i"), v["x"].alias("x"), v["value"].alias("value"))), F.array().cast("array<struct<i:int,x:double,value:double>>"))

    def step(cur, tick):
        near = F.array_min(F.transform(cur, lambda v: F.struct(F.abs(v["x"] - tick["x"]).alias("d"), v["i"].alias("i"), v["value"].alias("value"))))

        def take(best):
            fits = F.coalesce(best["d"] <= most, F.lit(False))
            status = F.when(tick["x"].isNull(), "no_place").when(best.isNull(), "none_free").when(fits, "ok").otherwise("too_far")
            row = F.struct(tick["tick"].alias("tick"), F.when(fits, best["value"]).alias("value"), best["d"].alias("dx"), status.alias("status"))
            return F.struct(F.array(row).alias("out"), F.when(fits, F.filter(cur, lambda v: v["i"] != best["i"])).otherwise(cur).alias("cur"))

        return let(near, take)

    rows = t.join(n, t["page"] == n["of"], "left").select("page", F.size("ticks").alias("n_ticks"), F.explode(folded(F.col("ticks"), free, step, lambda cur: F.array().cast(f"array<{kind}>"))).alias("o"))
    wrong = F.lit(False) if expected is None else F.col("n_ticks") != expected
    return rows.select("page", "o.tick", F.when(~wrong, F.col("o.value")).alias("value"), F.when(~wrong, F.round("o.dx", 4)).alias("dx"), F.when(wrong, "tick_count").otherwise(F.col("o.status")).alias("status"), "n_ticks")


def demanded(chart: DataFrame) -> DataFrame:
    """tick_chart()'s rows, if every tick has its number; else the job fails and names the first page that it meets that has not."""
    where = F.concat_ws(" ", F.lit("page"), F.col("page").cast("string"), F.lit("tick"), F.col("tick").cast("string"), F.col("status"))
    return chart.withColumn("status", F.when(F.col("status") == "ok", F.col("status")).otherwise(F.raise_error(where).cast("string")))


def row_labels(anchors: DataFrame, words: DataFrame, reach: float = 21.0) -> DataFrame:
    """For each row anchor the words within ``reach`` of its height, in reading order, as one label."""
    a, w = anchors.alias("a"), words.alias("w")
    rows = a.join(w, (F.col("a.page") == F.col("w.page")) & (F.abs(F.col("a.y") - F.col("w.y0")) < reach))
    x = F.struct(F.round("w.y0", 1).alias("r"), F.col("w.x0").alias("x0"), F.col("w.word").alias("word"), F.col("w.text").alias("text"))
    label = F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda v: v["text"]), " ")
    return rows.groupBy(F.col("a.page").alias("page"), F.col("a.anchor").alias("anchor")).agg(label.alias("label"))


def overlaps(texts: DataFrame, images: DataFrame, least: float = 0.30, text_area: float = 1.0, image_area: float = 4.0) -> DataFrame:
    """Text blocks covered by an image to at least ``least`` of their area, and whether it is painted later."""
    size = lambda x: (F.col(f"{x}.x1") - F.col(f"{x}.x0")) * (F.col(f"{x}.y1") - F.col(f"{x}.y0"))
    t, i = texts.alias("t"), images.alias("i")
    rows = t.join(i, F.col("t.page") == F.col("i.page")).filter((size("t") > text_area) & (size("i") >= image_area) & (F.trim("t.text") != ""))
    side = lambda k: F.greatest(F.lit(0.0), F.least(F.col(f"t.{k}1"), F.col(f"i.{k}1")) - F.greatest(F.col(f"t.{k}0"), F.col(f"i.{k}0")))
    share = side("x") * side("y") / size("t")
    return rows.select(F.col("t.page").alias("page"), F.col("t.box").alias("text_box"), F.col("i.box").alias("image_box"), share.alias("share"), (F.col("i.paint") > F.col("t.paint")).alias("on_top")).filter(F.col("share") >= least)


def hidden_text(spans: DataFrame, least_size: float = 3.0, tolerance: int = 12) -> DataFrame:
    """Spans that cannot be read, by the first reason: invisible mode, tiny size, colour of the background."""
    reason = F.when(F.col("render_mode") == 3, "invisible").when(F.col("size") < least_size, "tiny").when(colours_close(rgb(F.col("colour")), rgb(F.col("background")), tolerance), "same_colour")
    return spans.filter(F.trim("text") != "").withColumn("reason", reason).filter("reason IS NOT NULL")


def mean_colour(pixels: Column) -> Column:
    """Q3: mean red, green and blue of an array of packed colours."""
    channel = lambda k: F.aggregate(pixels, F.lit(0).cast("bigint"), lambda s, p: s + F.shiftright(p, k).bitwiseAND(255))
    return F.array(*[F.floor(channel(k) / F.size(pixels)) for k in (16, 8, 0)])


def layer_summary(findings: DataFrame) -> DataFrame:
    """Q4: findings and pages by reason."""
    return findings.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("pages"))
