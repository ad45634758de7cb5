"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its bytes. The ledger says which pairs of blob
and rule version were scanned and what was found. A run scans only blobs that the ledger has not seen under the
current rules, appends to the ledger and joins the findings back to all paths that hold a blob.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, fresh, map_rows, materialize

#: The contract's base kinds, in its order: pattern, group whose length counts, least length.
BASE_RULES = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.IGNORECASE | re.ASCII),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, 0),
    "hex": (r"[0-9a-f]+", 0, 24, 0),
}
#: Further kinds, after public formats of credentials.
MORE_RULES = {
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, 0),
    "forge": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40, 0),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, 0),
    "bearer": (r"[Bb]earer [A-Za-z0-9._~+/-]+", 0, 27, 0),
}
RULES = BASE_RULES | MORE_RULES
RULE_VERSION = hashlib.sha256(json.dumps(RULES).encode()).hexdigest()[:16]
KINDS = {kind: k for k, kind in enumerate(RULES)}

_COMPILED = {kind: (re.compile(p, flags), group, least) for kind, (p, group, least, flags) in RULES.items()}
# Runs are maximal where they start, so asking for the least length in the pattern finds the same matches sooner.
_COMPILED["hex"] = (re.compile(r"[0-9a-f]{24,}"), 0, 24)
_KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)

FINDING = "array<struct<kind:string,start:long,end:long>>"
LEDGER_SCHEMA = f"blob string, rule_version string, findings {FINDING}"


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; leftmost non-overlapping within each kind, in code points."""
    found = []
    for kind, (pattern, group, least) in _COMPILED.items():
        if kind == "assign" and not _KEYWORD.search(text):
            continue
        found += [(kind, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda x: (x[1], KINDS[x[0]]))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def versions(df: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path, blob: the content address of each version (null text: the empty blob)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return columns(df, path=path_col, blob=F.sha2(text, 256))


def scan_unseen(df: DataFrame, ledger: DataFrame | None = None, path_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows: each blob of df that the ledger lacks under rule_version, scanned once.

    One path carries each unseen blob to the scan. Choosing it groups hashes only, with partial sums, so that a blob
    that a third of all rows share costs one row a task. The carriers are a written table, so the join that fetches
    their texts knows its size: on an incremental run it is small and is broadcast by Spark's threshold; on a first
    run both sides are dealt by path, which is even whatever the copies.
    """
    held = versions(df, path_col, text_col)
    carriers = held.groupBy("blob").agg(F.min(F.xxhash64("path")).alias("carrier"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        carriers = carriers.join(seen, "blob", "left_anti")
    carriers = materialize(carriers, "unseen")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = columns(df, carrier=F.xxhash64(F.col(f"`{path_col}`")), blob=F.sha2(text, 256), text=text)
    todo = texts.join(carriers, ["carrier", "blob"], "left_semi").select("blob", "text")

    def batch(rows: dict) -> dict:
        return {
            "blob": rows["blob"],
            "rule_version": [rule_version] * len(rows["blob"]),
            "findings": [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in find_secrets(t)] for t in rows["text"]],
        }

    return map_rows(todo, batch, LEDGER_SCHEMA)


def scan_secrets(df: DataFrame, ledger: DataFrame | None = None, path_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings of every path, the ledger with this run's rows).

    The first has a row for each row of df: path, blob, findings (empty if none). The second is the old ledger and the
    new rows, the latter a written table. Null texts are the empty blob; empty input gives empty results; repeated
    rows are repeated paths and each gets its findings; columns of df with the ledger's names do no harm.
    """
    new = materialize(scan_unseen(df, ledger, path_col, text_col, rule_version), "ledger")
    whole = new if ledger is None else ledger.unionByName(new)
    # Most blobs hold nothing: only the others travel to the join. A repeated path may have brought a blob twice.
    hits = whole.where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).dropDuplicates(["blob"]).select("blob", "findings")
    hits = materialize(hits, "hits")
    found = versions(df, path_col, text_col).join(hits, "blob", "left")
    none = F.array().cast(FINDING)
    return found.select("path", "blob", F.coalesce("findings", none).alias("findings")), whole


def redact(df: DataFrame, findings: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with each finding of its blob replaced by ``[kind]`` (overlaps once, by the first); other columns stay.

    Texts and findings meet by content address, dealt alike at every size; Spark splits an address that many share.
    Null texts stay null, empty tables on either side do no harm, and columns of any name are left alone.
    """
    names = df.columns
    blob, spans, done = fresh(df, "blob", "spans", "done")
    hits = findings.where(F.size("findings") > 0).select(F.col("blob").alias(blob), F.col("findings").alias(spans)).dropDuplicates([blob])
    hits = materialize(hits, "redact")
    old = F.col(f"`{text_col}`")
    joined = df.withColumn(blob, F.sha2(F.coalesce(old, F.lit("")), 256)).join(hits.hint("merge"), blob, "left")
    # Spans come by start: each piece is the text since the furthest end so far, then the kind's mark.
    step = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, x: F.when(
            x["start"] >= acc["at"],
            F.struct(
                F.concat(acc["out"], F.substring(old, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]")).alias("out"),
                x["end"].alias("at"),
            ),
        ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))),
    )
    masked = joined.withColumn(done, F.when(F.col(spans).isNotNull(), step))
    text = F.when(F.col(spans).isNull(), old).otherwise(F.concat(F.col(f"{done}.out"), F.substring(old, (F.col(f"{done}.at") + 1).cast("int"), F.length(old))))
    return masked.withColumn(text_col, text).select(*(F.col(f"`{n}`") for n in names))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from scan_secrets' first result."""
    is_base = lambda x: x["kind"].isin(*BASE_RULES)
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(shown(F.filter("findings", is_base)), 256).alias("base_sha256"),
        shown(F.col("findings")).alias("spans"),
        "blob",
    )


def _oracle() -> str:
    """DuckDB: matches and the gaps between them give the positions. Patterns are spelled for both cases where case doesn't count."""

    def both_cases(pattern: str) -> str:
        return re.sub(r"\[[^]]*\]|\\x..|[A-Za-z]", lambda m: f"[{m[0].upper()}{m[0].lower()}]" if len(m[0]) == 1 else m[0], pattern)

    parts = []
    for k, (kind, (pattern, group, least, flags)) in enumerate(RULES.items()):
        p = (both_cases(pattern) if flags & re.IGNORECASE else pattern).replace("'", "''")
        # Short hex runs are many; as runs are maximal, only those of the least length are looked for.
        p = "[0-9a-f]{24,}" if kind == "hex" else p
        size = f"length(regexp_extract(m, '{p}', {group}))" if group else "length(m)"
        start = "coalesce(list_sum(list_transform(gs[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)"
        parts.append(
            f"SELECT doc_id, blob, row, {k} AS k, '{kind}' AS kind, unnest(list_filter(list_transform(ms, lambda m, i: {{'s': {start}, 'n': length(m), 'ok': {size} >= {least}}}), lambda x: x.ok)) AS x "
            f"FROM (SELECT *, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gs FROM d)"
        )
    show = "string_agg(kind || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.n AS BIGINT), ',' ORDER BY x.s, k)"
    n = lambda kind: f"count(*) FILTER (WHERE kind = '{kind}')"
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS blob, row_number() OVER () AS row FROM documents), f AS ("
        + " UNION ALL ".join(parts)
        + f"), g AS (SELECT row, {n('assign')} AS n_assign, {n('access')} AS n_access, {n('hex')} AS n_hex, {show} FILTER (WHERE k < 3) AS base, {show} AS spans FROM f GROUP BY row) "
        + "SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, blob FROM d LEFT JOIN g USING (row)"
    )


ORACLE = _oracle()
