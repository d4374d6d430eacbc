"""Secret scans over an incremental blob ledger.

Every historical version of a path is content-addressed; only (blob, rule version) pairs that the ledger
doesn't know are scanned, and findings are joined back to all paths that ever held the blob.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import let, materialize, running_sum, scratch_dir

RULE_VERSION = "1"
SPAN = "struct<kind_order:int,kind:string,start:int,end:int>"
LEDGER_SCHEMA = f"blob string, rule_version string, findings array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost first and not overlapping, that are long enough.

    ``min_chars`` holds for ``group``, 0 being the whole match; a match that is too short is dropped and
    not looked into again. ``gate`` is a cheaper pattern that every text with a match contains.

    With ``plain`` the spans are those of that pattern, of any length. ``pattern`` then finds the same in
    linear time with a backtracking engine: it enters a run of letters only at its start, and its first
    group, which ends where the match does, is the span.
    """

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 0
    gate: str | None = None
    plain: str | None = None


BASE_RULES = (
    Rule(
        "assign",
        "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    # runs that are too short can't hold a longer match, so the length may stand in the pattern
    Rule("access", "AKIA[A-Z0-9]{14,}", gate="AKIA"),
    Rule("hex", "[0-9a-f]{16,}"),
)
#: Formats of well-known credentials, beyond the base kinds.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", gate="-----BEGIN"),
    # if the first eyJ of a part starts no match, no later one of that part does
    Rule(
        "jwt",
        "(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{8,}+\\.eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+)",
        gate="eyJ",
        plain="eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}",
    ),
    Rule("forge", "(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", gate="gh[pousr]_|glpat-"),
    Rule("chat", "xox[abeoprs]-[A-Za-z0-9-]{10,}", gate="xox[abeoprs]-"),
    Rule("cloud", "AIza[A-Za-z0-9_-]{35}", gate="AIza"),
    Rule("payment", "[rs]k_live_[A-Za-z0-9]{16,}", gate="k_live_"),
    # nor any letter of a scheme but its first
    Rule(
        "login",
        "(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]*+://[^\\x00-\\x20/?#@:]++:[^\\x00-\\x20/?#@]++@)",
        gate="://",
        plain="[a-z][a-z0-9+.-]*://[^\\x00-\\x20/?#@:]+:[^\\x00-\\x20/?#@]+@",
    ),
)
RULES = BASE_RULES + MORE_RULES


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of the rule's spans, in code points, end exclusive.

    The text split at the matches, and the matches, alternate; their lengths add up to the places.
    """
    pattern = F.lit(rule.pattern)
    sizes_of = lambda group: F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), lambda m: F.char_length(m))

    def placed(gaps: Column, sizes: Column) -> Column:
        ends = running_sum(F.zip_with(sizes, gaps, lambda size, gap: size + F.coalesce(F.char_length(gap), F.lit(0))))

        own = sizes_of(1) if rule.plain else sizes

        def span(end: Column, size: Column) -> Column:
            return F.struct(
                F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), (end - size).alias("start"), end.alias("end")
            )

        spans = let(own, lambda o: F.transform(F.slice(ends, F.lit(1), F.size(sizes)), lambda end, i: span(end, F.get(o, i))))
        if not rule.min_chars:
            return spans
        kept = sizes_of(rule.group) if rule.group else sizes
        return let(kept, lambda k: F.filter(spans, lambda s, i: F.get(k, i) >= rule.min_chars))

    there = text.rlike(rule.gate or rule.pattern)
    found = let(F.split(text, rule.pattern, -1), lambda gaps: let(sizes_of(0), lambda sizes: placed(gaps, sizes)))
    return F.when(there, found).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def find_secrets(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of all rules by start, then by the order of the rules."""
    found = F.flatten(F.array(*[rule_spans(text, r, i) for i, r in enumerate(rules)]))
    by_start = F.transform(
        found, lambda s: F.struct(s["start"].alias("start"), s["kind_order"].alias("kind_order"), s.alias("span"))
    )
    return F.transform(F.array_sort(by_start), lambda s: s["span"])


def blob_of(text: Column) -> Column:
    """The content address; null counts as the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_new(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    text_col: str = "text",
    *,
    rules: tuple[Rule, ...] = RULES,
    rule_version: str = RULE_VERSION,
) -> DataFrame:
    """The ledger's new rows: each blob among ``versions`` not yet scanned by this rule version, with its
    findings (none is an entry too, so that clean blobs aren't scanned again).

    With a ledger the unseen addresses are found first, on a table of addresses; where they are few the
    other texts aren't shuffled.
    """
    blob = blob_of(F.col(text_col)).alias("blob")
    texts = versions.select(blob, F.coalesce(text_col, F.lit("")).alias("_text"))
    once = texts.groupBy("blob").agg(F.min("_text").alias("_text"))  # a blob in many paths is combined early
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob")
        unseen = versions.select(blob).distinct().join(known, "blob", "left_anti")
        # on the grouping key, so it is pushed below the aggregate where the unseen are few enough to broadcast
        once = once.join(materialize(unseen, "unseen-blobs"), "blob", "left_semi")
    return once.select("blob", F.lit(rule_version).alias("rule_version"), find_secrets(F.col("_text"), rules).alias("findings"))


def one_per_blob(ledger: DataFrame) -> DataFrame:
    """A row per blob and rule version; the scan of a blob is always the same, so any will do."""
    return ledger.groupBy("blob", "rule_version").agg(F.any_value("findings").alias("findings"))


def report_findings(versions: DataFrame, ledger: DataFrame, text_col: str = "text", *, rule_version: str = RULE_VERSION) -> DataFrame:
    """``versions`` without the text, plus ``blob`` and the ``findings`` that the ledger has for it.

    A blob that the ledger holds several times, as after two writers, counts once. What is joined is
    written first: it is an aggregate, and the join's hot blobs couldn't be split beside one.
    """
    hits = one_per_blob(ledger.where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)))
    hits = materialize(hits.select("blob", "findings"), "blob-findings")
    paths = versions.drop("blob", "findings").withColumn("blob", blob_of(F.col(text_col))).drop(text_col)
    report = paths.join(hits, "blob", "left").withColumn(
        "findings", F.coalesce("findings", F.expr(f"cast(array() as array<{SPAN}>)"))
    )
    return report.select(*[F.col(f"`{c}`") for c in paths.columns], "findings")


def scan_versions(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    text_col: str = "text",
    *,
    rules: tuple[Rule, ...] = RULES,
    rule_version: str = RULE_VERSION,
) -> tuple[DataFrame, DataFrame]:
    """Scan what is new and report on all paths: (``versions`` without the text, plus ``blob`` and
    ``findings``; the new ledger, old rows included).

    Null and empty texts are one blob, without findings. Repeated rows and copies share a blob: it is
    scanned once and each row gets the findings. Columns of the added names in the input are replaced.
    An empty table gives an empty report and leaves the ledger as it is. Texts are scanned whole, in time
    that grows with their length.

    Plan: texts meet once, by content address, with copies combined before the shuffle; the scan's
    result is written, and joined to the paths by address in a join whose hot blobs can be split.
    """
    fresh = materialize(scan_new(versions, ledger, text_col, rules=rules, rule_version=rule_version), "ledger")
    full = fresh if ledger is None else one_per_blob(ledger.unionByName(fresh))
    return report_findings(versions, full, text_col, rule_version=rule_version), full


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger in a folder, a row per blob and rule version; None where there is none yet."""
    rows = _entries(spark, path)
    return None if rows is None else one_per_blob(rows)


def _entries(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows as they were appended: writers that ran at the same time may both have scanned a blob."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def scan_into_ledger(
    versions: DataFrame,
    path: str,
    text_col: str = "text",
    *,
    rules: tuple[Rule, ...] = RULES,
    rule_version: str = RULE_VERSION,
) -> DataFrame:
    """``scan_versions`` with the ledger kept in the folder ``path``: what is new is scanned and appended,
    and the report is read from the ledger alone.

    Nulls, empty and long texts, repeated rows and clashing names are as in ``scan_versions``; an empty
    table appends nothing and gives an empty report. A run that is repeated after its append, and writers
    that append the same blobs at once, leave more rows but change no report. Rows appear with Spark's
    commit of the whole append, so a run lost before it is as one that never was.
    """
    spark = versions.sparkSession
    fresh = scan_new(versions, _entries(spark, path), text_col, rules=rules, rule_version=rule_version)
    fresh.write.mode("append").partitionBy("rule_version").parquet(path)
    return report_findings(versions, _entries(spark, path), text_col, rule_version=rule_version)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = f"{scratch_dir(spark)}/ledger"
    scan_into_ledger(docs, ledger)  # the first version set: all of it is new
    report = scan_into_ledger(docs, ledger)  # the next one: only what the ledger doesn't know is scanned
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("findings", lambda s: s["kind_order"] < len(BASE_RULES))
    return report.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("findings")).alias("spans"),
    )


def _sql() -> str:
    """For each rule the i-th match stands behind i gaps and the matches before it. DuckDB's patterns are
    automata, so it takes the plain ones."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    sizes = "list_transform({}, lambda x: length(x))"
    per_rule = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS o, '{r.kind}' AS kind, {r.min_chars} AS least, "
        + f"{sizes.format(f'regexp_split_to_array(t, {quoted(r.plain or r.pattern)})')} AS g, "
        + f"{sizes.format(f'regexp_extract_all(t, {quoted(r.plain or r.pattern)}, 0)')} AS m, "
        + f"{sizes.format(f'regexp_extract_all(t, {quoted(r.plain or r.pattern)}, {r.group})')} AS k FROM d"
        for i, r in enumerate(RULES)
    )
    counts = ", ".join(f"count(*) FILTER (s.kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    text = "s.kind || ':' || s.a || ':' || s.b"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), r AS (
  {per_rule}
), s AS (
  SELECT doc_id, o, kind, a, a + m[i] AS b FROM (
    SELECT *, CAST(list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0) AS BIGINT) AS a
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM r WHERE len(m) > 0)
  ) WHERE k[i] >= least
)
SELECT d.doc_id, {counts},
       sha256(coalesce(string_agg({text}, ',' ORDER BY s.a, s.o) FILTER (s.o < {len(BASE_RULES)}), '')) AS base_sha256,
       coalesce(string_agg({text}, ',' ORDER BY s.a, s.o), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""


OP9_SQL = _sql()
