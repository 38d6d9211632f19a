"""Reconciliations, accounting, gates, fingerprints and text audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import set_diff


def reconcile_ledger(ledger: DataFrame, remote: DataFrame, key: str = "job_id") -> DataFrame:
    """Each job with its state: both, missing (ledger only), unexpected (remote only), or status_mismatch."""
    a = ledger.select(key, F.col("status").alias("ledger_status"), F.lit(True).alias("_l"))
    b = remote.select(key, F.col("status").alias("remote_status"), F.lit(True).alias("_r"))
    state = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "unexpected").when(~F.col("ledger_status").eqNullSafe(F.col("remote_status")), "status_mismatch").otherwise("both")
    return a.join(b, key, "full_outer").select(key, "ledger_status", "remote_status", state.alias("state"))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def gate_table(values: DataFrame, checks: list[tuple[str, Column, str]]) -> DataFrame:
    """One row for each check of a one-row table: name, passed, observed, expected. A null observation fails."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(ok, F.lit(False)).alias("passed"), F.lit(want).alias("expected")) for n, ok, want in checks])
    return values.select(F.explode(rows).alias("c")).select("c.*")


def verdict(gates: DataFrame) -> DataFrame:
    return gates.agg(F.every("passed").alias("accepted"), F.sum(F.expr("cast(not passed as int)")).alias("failed"))


def account_acquisitions(dates: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Each date once, with a flag for each stage that has it and the first stage that lacks it as the reason."""
    out = dates.select("date").distinct()
    for name, got in stages:
        out = out.join(got.select("date", F.lit(True).alias(name)).distinct(), "date", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    reason = F.coalesce(*[F.when(~F.col(n), F.lit(f"not in {n}")) for n, _ in stages])
    return out.withColumn("reason", reason)


def hour_identity_gate(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Per hour, whether the dates at hand are exactly those expected: sets are compared, not counts."""
    diff = set_diff(expected, got, ["hour", "date"])
    n = lambda s: F.sum((F.col("state") == s).cast("int"))
    return diff.groupBy("hour").agg(n("both").alias("both"), n("missing").alias("missing"), n("unexpected").alias("unexpected"), F.every(F.col("state") == "both").alias("passed"))


def _row_sums(df: DataFrame) -> tuple[Column, list[Column]]:
    """A row's SHA-256 over its columns by name, and sums of its four parts, whatever the order of rows."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)]), 256)
    part = lambda k: F.conv(F.substring("_h", 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")
    return row, [F.pmod(F.sum(part(k)), F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)").alias(f"s{k}") for k in range(4)]


def table_fingerprint(df: DataFrame) -> DataFrame:
    """rows and a SHA-256 that any order of the same rows has, repeats counted: over four sums of the rows' own SHA-256.

    Sums are made in tasks before anything moves, so no rows are gathered or sorted.
    """
    row, sums = _row_sums(df)
    total = df.select(row.alias("_h")).agg(F.count("*").alias("rows"), *sums)
    return total.select("rows", F.sha2(F.concat_ws(":", "rows", *[F.coalesce(f"s{k}", F.lit(0)) for k in range(4)]), 256).alias("fingerprint"))


def _leaf(key: list[str], depth: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - 4 * depth) if depth else F.lit(0).cast("long")


def fingerprint_tree(df: DataFrame, key: list[str], depth: int = 4) -> DataFrame:
    """level, node, rows, fingerprint: a tree of 16 branches over the range of the keys' hashes.

    Level ``depth`` has 16^depth leaves, level 0 the root, whose fingerprint is table_fingerprint's. A node stands for the rows
    whose keys begin with it; its fingerprint is of their sums, so it is the sum of its branches. Nodes without rows are
    left out, but for the root.
    """
    row, sums = _row_sums(df)
    leaves = df.select(row.alias("_h"), _leaf(key, depth).alias("node")).groupBy("node").agg(F.count("*").alias("rows"), *sums).withColumn("level", F.lit(depth))
    named = leaves.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("at", F.expr(f"shiftrightunsigned(node, 4 * ({depth} - l))"))
    up = named.groupBy(F.col("l").alias("level"), F.col("at").alias("node")).agg(F.sum("rows").alias("rows"), *[F.pmod(F.sum(f"s{k}"), F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)").alias(f"s{k}") for k in range(4)])
    return up.select("level", "node", "rows", F.sha2(F.concat_ws(":", "rows", *[f"s{k}" for k in range(4)]), 256).alias("fingerprint"))


def differing_ranges(old: DataFrame, new: DataFrame, depth: int = 4) -> DataFrame:
    """node of each leaf in which two trees differ, found from the root down: only branches of nodes that differ are compared."""
    a, b = (x.select("level", "node", F.struct("rows", "fingerprint").alias(c)) for x, c in ((old, "_a"), (new, "_b")))
    open_ = None
    for level in range(depth + 1):
        x, y = a.where(F.col("level") == level).drop("level"), b.where(F.col("level") == level).drop("level")
        if open_ is not None:
            under = open_.withColumnRenamed("node", "_up")
            x, y = (z.withColumn("_up", F.expr("shiftrightunsigned(node, 4)")).join(under, "_up", "left_semi").drop("_up") for z in (x, y))
        open_ = x.join(y, "node", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node")
    return open_


def drift_by_ranges(frozen: DataFrame, current: DataFrame, key: list[str], depth: int = 4, old: DataFrame | None = None) -> DataFrame:
    """key, state of the rows that are missing, new or changed, from the ranges of keys whose fingerprints differ.

    ``old`` is the frozen table's tree, if it was kept; rows of equal ranges meet in no join. Keys are not null and stand once.
    """
    leaf = _leaf(key, depth).alias("_leaf")
    ranges = differing_ranges(old if old is not None else fingerprint_tree(frozen, key, depth), fingerprint_tree(current, key, depth), depth).withColumnRenamed("node", "_leaf")
    side = lambda df, c: df.select(*key, _row_sums(df)[0].alias(c), leaf).join(ranges, "_leaf", "left_semi").drop("_leaf")
    both = side(frozen, "_a").join(side(current, "_b"), key, "full_outer")
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "new").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(*key, state.alias("state")).where("state is not null")


def drift(frozen: DataFrame, current: DataFrame, critical: Column) -> DataFrame:
    """Files (path, sha256) that are missing, changed or new; critical ones fail, others warn."""
    a = frozen.select("path", F.col("sha256").alias("old"))
    b = current.select("path", F.col("sha256").alias("new"))
    state = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "new").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    out = a.join(b, "path", "full_outer").select("path", state.alias("state"))
    return out.withColumn("severity", F.when(F.col("state") == "same", "ok").when(critical & F.col("state").isin("missing", "changed"), "fail").otherwise("warn"))


def line_audit(docs: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Lines that break a rule (name, pattern, severity), with document and line number. Rules are a short list."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hits = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, p, s in rules]), lambda h: h.isNotNull())
    return lines.withColumn("h", F.explode(hits)).select("doc_id", "line_no", "h.rule", "h.severity")


def cited_numbers(docs: DataFrame, values: DataFrame) -> DataFrame:
    """For each value (name, value), in how many documents it stands with one to four decimals."""
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![0-9.])([0-9]+\.[0-9]{1,4})(?![0-9])"), 1))).alias("token"))
    forms = values.select("name", F.explode(F.array_distinct(F.array(*[F.format_string(f"%.{k}f", "value") for k in (1, 2, 3, 4)]))).alias("token"))
    hits = found.join(forms, "token").select("name", "doc_id").distinct().groupBy("name").agg(F.count("*").alias("documents"))
    return values.join(hits, "name", "left").select("name", F.coalesce("documents", F.lit(0)).alias("documents"))


def replay_check(frozen: DataFrame, current: DataFrame, key: str, tolerances: dict[str, float]) -> DataFrame:
    """Whether a recomputed table keeps each column of a frozen one within its tolerance; absent keys fail."""
    a = frozen.select(key, *[F.col(c).alias(f"_a_{c}") for c in tolerances], F.lit(True).alias("_l"))
    b = current.select(key, *[F.col(c).alias(f"_b_{c}") for c in tolerances], F.lit(True).alias("_r"))
    fine = F.col("_l") & F.col("_r")
    for c, t in tolerances.items():
        fine = fine & (F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) <= t)
    return a.join(b, key, "full_outer").select(key, F.coalesce(fine, F.lit(False)).alias("passed"))


def upsert_latest(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The union with one row for each key, the best by ``order``."""
    rows = old.unionByName(new, allowMissingColumns=True)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def completion_report(expected: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counts of expected, submitted, ended, failed and missing downloads, and whether all is clean."""
    j = expected.select("pair_id").distinct().join(jobs, "pair_id", "left")
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    agg = j.agg(
        F.countDistinct("pair_id").alias("expected"), n(F.col("job_id").isNotNull()).alias("submitted"), n(F.col("status").isin("SUCCEEDED", "FAILED")).alias("ended"),
        n(F.col("status") == "FAILED").alias("failed"), n((F.col("status") == "SUCCEEDED") & ~F.coalesce("download_ok", F.lit(False))).alias("not_downloaded"),
    )
    return agg.withColumn("all_clean", (F.col("submitted") == F.col("expected")) & (F.col("ended") == F.col("submitted")) & (F.col("failed") == 0) & (F.col("not_downloaded") == 0))


def window_parity(items: DataFrame) -> DataFrame:
    """Per window, whether both polarisations have the same times and the items are as many as the hits."""
    times = lambda p: F.array_sort(F.collect_list(F.when(F.col("polarisation") == p, F.col("ts"))))
    agg = items.groupBy("window").agg(F.count("*").alias("items"), F.first("hits").alias("hits"), times("VV").alias("_v"), times("VH").alias("_h"))
    return agg.select("window", "items", "hits", ((F.col("_v") == F.col("_h")) & (F.col("items") == F.col("hits"))).alias("sound"))


def collection_checks(bursts: DataFrame) -> DataFrame:
    """Rules of a burst collection: count, contiguity, one path, direction and sub-swath, and spread of the times."""
    agg = bursts.agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), (F.max("id") - F.min("id") + 1).alias("span"), F.countDistinct("path").alias("paths"),
        F.countDistinct("direction").alias("directions"), F.countDistinct("subswath").alias("subswaths"), (F.max(F.unix_seconds("ts")) - F.min(F.unix_seconds("ts"))).alias("seconds"),
    )
    rules = [("count", "n >= 1"), ("distinct", "n = ids"), ("contiguous", "span = ids"), ("one path", "paths = 1"), ("one direction", "directions = 1"), ("one sub-swath", "subswaths = 1"), ("times", "seconds <= 120")]
    return agg.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.expr(c).alias("passed")) for n, c in rules])).alias("c")).select("c.*")


def metric_ledger(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of metrics (metric, definition, value): equal names are told apart by their definition."""
    out = None
    for definition, df in parts.items():
        row = df.select("metric", F.lit(definition).alias("definition"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def uncertainty_budget(rows: DataFrame, by: list[str]) -> DataFrame:
    """Root sum of squares of the parts of each kind; kinds are never added to each other."""
    return rows.groupBy(*by, "kind").agg(F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))).alias("combined"), F.count("*").alias("parts"))
