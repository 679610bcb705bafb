"""Writers of facts, aggregates and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.operators.evaluate import mode_summary, savings
from pagetrail.operators.quality import by_kind, coverage_counts, duplicates


def write_jsonl(df: DataFrame, path: str) -> None:
    """K1, K2: a compact record a line, nulls kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """K1: one file that holds one JSON array, a record a line, in the order of columns that tell every row from the others; nulls kept.

    The rows are sorted on the cluster and pass one task a row at a time. An empty table is an empty array."""
    one = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    first = df.agg(F.min(F.struct(*order)).alias("first"))  # one row: it alone has no comma before it
    rows = df.select(F.lit(1).alias("__part"), F.struct(*order).alias("__at"), one.alias("__json")).crossJoin(F.broadcast(first))
    rows = rows.select("__part", "__at", F.concat(F.when(F.col("__at") == F.col("first"), "").otherwise(","), F.col("__json")).alias("value"))
    ends = [rows.sparkSession.range(1).select(F.lit(p).alias("__part"), F.lit(None).cast(rows.schema["__at"].dataType).alias("__at"), F.lit(v).alias("value")) for p, v in ((0, "["), (2, "]"))]
    ends[0].unionByName(rows).unionByName(ends[1]).orderBy("__part", "__at").select("value").coalesce(1).write.mode("overwrite").text(path)


def aggregates_document(growth: DataFrame, checksum: DataFrame) -> DataFrame:
    """K3: one row {aggregates, checksum} as JSON. Both are small results: a row a segment and a period."""
    one = lambda d, name: d.agg(F.to_json(F.sort_array(F.collect_list(F.struct("*")))).alias(name))
    both = one(growth, "a").crossJoin(one(checksum, "c"))
    return both.select(F.concat(F.lit('{"aggregates":'), "a", F.lit(',"checksum":'), "c", F.lit("}")).alias("value"))


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """K5: a pipe table of a report's rows; more than ``limit`` are an error, as a report is for reading: take the top ones first."""
    text = lambda v: "—" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    return "\n".join(lines + ["| " + " | ".join(map(text, r)) + " |" for r in rows])


def eval_report(results: DataFrame, limit: int = 1000) -> str:
    """K5: the report of an evaluation from its rows (id, type, mode, passed, values_ok, pages_ok, tokens, latency, cost, unverified, error): a summary
    by mode, a row a question, then numbers without support and errors, if there are any. Modes and questions come in order of their names."""
    s = mode_summary(results).withColumn("tokens_median", F.col("tokens_median").cast(results.schema["tokens"].dataType)).orderBy("mode")
    of = lambda a, b: F.concat_ws("/", F.col(a).cast("string"), F.col(b).cast("string"))
    money = lambda c, n: F.concat(F.lit("$"), F.format_string(f"%.{n}f", F.col(c)))
    summary = s.select("mode", of("passed", "runs").alias("passed"), of("values_ok_true", "values_ok_of").alias("values"), of("pages_ok_true", "pages_ok_of").alias("pages"), "tokens_median", "latency_median", money("cost", 2).alias("cost"))
    yes = lambda c: F.when(F.col(c), "yes").when(~F.col(c), "no").alias(c)
    rows = results.orderBy("id", "mode").select("id", "type", "mode", F.when(F.col("passed"), "passed").otherwise("failed").alias("outcome"), yes("values_ok"), yes("pages_ok"), "tokens", "latency", money("cost", 3).alias("cost"))
    parts = ["# Evaluation", "## By mode", markdown(summary, limit), "## By question", markdown(rows, limit)]
    loose = results.filter(F.size("unverified") > 0).orderBy("id", "mode").select("id", "mode", F.array_join("unverified", ", ").alias("numbers"))
    failed = results.filter("error IS NOT NULL").orderBy("id", "mode").select("id", "mode", "error")
    for title, table in (("## Numbers without support in the context", loose), ("## Errors", failed)):
        if not table.isEmpty():
            parts += [title, markdown(table, limit)]
    return "\n\n".join(parts) + "\n"


def audit_report(merged: DataFrame, covered: DataFrame, objects: DataFrame, controls: DataFrame, ruled: DataFrame, layers: DataFrame, limit: int = 25) -> str:
    """K5: the report of an extraction from its rows, as numbered sections: totals, reconciliation (classes, mismatches, what one side alone has, by page), controls, completeness
    (objects by kind, verdicts, pages with numbers but no record, pages of fewer records than declared), values out of range and repeated, layers.

    merged: linkage.reconcile(); covered: quality.coverage(); objects; controls: quality.controls(); ruled: quality.range_rules(); layers: layout.layer_summary(). Each table has at
    most ``limit`` rows, the first in the order named by its columns, and says how many there are if that is more."""

    def top(rows: DataFrame, *order) -> str:
        n = rows.count()
        if not n:
            return "none"
        return markdown(rows.orderBy(*order).limit(limit), limit) + (f"\n\n{n} in all" if n > limit else "")

    mismatch = merged.filter("kind = 'mismatch'").select("pg", "m", "s", "p", "v_left", "v_right")
    alone = lambda kind: merged.filter(F.col("kind") == kind)
    by_page = alone("only_right").groupBy("pg").agg(F.count(F.lit(1)).alias("n"))
    totals = covered.agg(F.count(F.lit(1)).alias("pages"), F.sum("objects").alias("objects"), F.sum("numeric").alias("with_numbers"), F.sum("n_parser").alias("left_records"), F.sum("n_vision").alias("right_records"))
    gaps = covered.filter((F.col("numeric") > 0) & (F.col("n_parser") + F.col("n_vision") == 0)).select("pg", "objects", "numeric")
    parts = [
        ("# Audit of the extraction", None),
        ("## 1. Totals", markdown(totals)),
        ("## 2. Reconciliation", top(merged.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind")),
        ("### 2.1. Mismatches", top(mismatch, *mismatch.columns)),
        ("### 2.2. Left side only", top(alone("only_left").select("pg", "m", "s", "p", "v"), "pg", "m", "s", "p", "v")),
        ("### 2.3. Right side only, by page", top(by_page, F.desc("n"), "pg")),
        ("## 3. Controls", top(controls.groupBy("ok").agg(F.count(F.lit(1)).alias("n")), "ok")),
        ("### 3.1. Controls that fail", top(controls.filter("NOT ok"), *controls.columns)),
        ("## 4. Objects by kind", top(by_kind(objects), F.desc("n"), "kind")),
        ("### 4.1. Pages with numbers and no record", top(gaps, F.desc("numeric"), "pg")),
        ("### 4.2. Pages by completeness", top(coverage_counts(covered), "verdict")),
        ("### 4.3. Partial pages", top(covered.filter("verdict = 'partial'").select("pg", "declared", "n_parser", "n_vision"), F.desc("declared"), "pg")),
        ("## 5. Values out of range", top(ruled, *ruled.columns)),
        ("### 5.1. Repeated records, by page", top(duplicates(merged), F.desc("extra"), "pg")),
        ("## 6. Layers", top(layers, "reason")),
    ]
    return "\n\n".join(x for pair in parts for x in pair if x is not None) + "\n"


def savings_report(results: DataFrame, baseline: str = "full") -> str:
    """The tokens saved by each other mode against the baseline, a line each; empty without rows of the baseline."""
    rows = savings(mode_summary(results), baseline).filter((F.col("mode") != baseline) & F.col("saved_pct").isNotNull()).orderBy("mode").collect()  # a row a mode
    return "\n".join(f"- `{r['mode']}`: {r.saved_pct:.0f}%" for r in rows)


def replace_between(text: str, begin: str, end: str, body: str) -> str:
    """K6: the text with what stands between the two markers replaced."""
    head, found, rest = text.partition(begin)
    old, closed, tail = rest.partition(end)
    if not found or not closed:
        raise ValueError("markers not found")
    return f"{head}{begin}\n{body}\n{end}{tail}"
