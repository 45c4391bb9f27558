"""Column-expression builders for ticket text: all JVM-side, no UDF.

Every function takes and returns ``Column`` objects so that callers compose
them inside one projection and whole-stage codegen keeps them in one span.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from relaylake import constants as K

# The characters that Python's str.strip() removes. Spark's
# trim() removes only spaces, so btrim with an explicit set is used instead.
WHITESPACE = (" \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
              "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_BIG = 2147483647


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, however often the
    body names it (an expression named in a lambda is computed at every element)."""
    return F.get(F.transform(F.array(value), body), 0)


def contains_any(text: Column, terms: list[str]) -> Column:
    cond = F.lit(False)
    for term in terms:
        cond = cond | text.contains(term)
    return cond


def str_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def empty_str_array() -> Column:
    return F.array().cast("array<string>")


# ---- C2 / C3: repository hint ------------------------------------------------
def repo_from_tags(tags: Column, prefix: str = K.REPO_TAG_PREFIX) -> Column:
    """First tag that starts with the prefix (case-insensitive); later tags are
    not tried even when the first one is blank after the prefix."""
    pfx = prefix.lower().strip()
    first = F.get(F.filter(tags, lambda t: F.lower(strip(t)).startswith(pfx)), 0)
    return F.nullif(strip(F.substring(strip(first), len(pfx) + 1, _BIG)), F.lit(""))


def resolve_repo(repo_name: Column, tags: Column, default: str = K.DEFAULT_REPO) -> Column:
    return F.coalesce(F.nullif(strip(repo_name), F.lit("")), repo_from_tags(tags), F.lit(default))


# ---- C4-C10: plan extraction -------------------------------------------------
def requirement_text(title: Column, description: Column, criteria: Column) -> Column:
    """Original-case blob; callers lower() it for keyword tests."""
    return F.concat_ws(" ", title, description, criteria)


def has_jdbc(blob_lower: Column) -> Column:
    return contains_any(blob_lower, K.JDBC_TERMS)


def has_flat_file(blob_lower: Column) -> Column:
    return contains_any(blob_lower, K.FLAT_FILE_TERMS)


def source_types(blob_lower: Column) -> Column:
    j, f = has_jdbc(blob_lower), has_flat_file(blob_lower)
    return (F.when(j & f, str_array(["jdbc", "flat_file"]))
            .when(j, str_array(["jdbc"]))
            .when(f, str_array(["flat_file"]))
            .otherwise(str_array(["unknown"])))


def ingestion_mode(blob_lower: Column) -> Column:
    return (F.when(blob_lower.contains("overwrite"), F.lit("overwrite"))
            .otherwise(F.lit("append")))


def ingestion_explicit(blob_lower: Column) -> Column:
    return blob_lower.contains("overwrite") | blob_lower.contains("append")


def table_match(text: Column) -> Column:
    """The first catalog.schema.table in the text ('' when there is none).
    One regex evaluation per row; the parts are split from the match."""
    return F.regexp_extract(text, K.TABLE_PATTERN, 0)


def table_parts(match: Column, item_id: Column) -> tuple[Column, Column, Column, Column]:
    """(catalog, schema, table, explicit) from ``table_match``: lower-cased
    parts, or main / bronze / wi_<id>_table when the text names no table.
    The three groups contain no '.', so splitting the match recovers them."""
    parts = F.split(match, r"\.")
    explicit = match != ""
    return (F.when(explicit, F.lower(F.get(parts, 0))).otherwise(F.lit(K.DEFAULT_CATALOG)),
            F.when(explicit, F.lower(F.get(parts, 1))).otherwise(F.lit(K.DEFAULT_SCHEMA)),
            F.when(explicit, F.lower(F.get(parts, 2)))
             .otherwise(F.concat(F.lit("wi_"), item_id.cast("string"), F.lit("_table"))),
            explicit)


def slug(title: Column) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.left(s, F.lit(35)), F.lit("")), F.lit("work-item"))


def branch_name(item_id: Column, title: Column, prefix: str = K.BRANCH_PREFIX) -> Column:
    return F.concat(F.lit(prefix), item_id.cast("string"), F.lit("-"), slug(title))


def risk_notes(sources: Column, mode: Column) -> Column:
    return F.array_compact(F.array(
        F.when(F.array_contains(sources, "jdbc"), F.lit(K.RISK_JDBC)),
        F.when(mode == "overwrite", F.lit(K.RISK_OVERWRITE)),
    ))


def clarification_questions(table_known: Column, sources_known: Column, mode_known: Column,
                            repo_name: Column, criteria: Column) -> Column:
    """The five questions in their fixed order, only those still open."""
    return F.array_compact(F.array(
        F.when(~table_known, F.lit(K.Q_TABLE)),
        F.when(~sources_known, F.lit(K.Q_SOURCE)),
        F.when(~mode_known, F.lit(K.Q_MODE)),
        F.when(F.coalesce(repo_name, F.lit("")) == "", F.lit(K.Q_REPO)),
        F.when(strip(criteria) == "", F.lit(K.Q_CRITERIA)),
    ))


# ---- C23: idempotency key ----------------------------------------------------
def run_key(item_id: Column, title: Column, description: Column) -> Column:
    fingerprint = F.concat_ws("|", item_id.cast("string"), strip(title), strip(description))
    return F.concat(item_id.cast("string"), F.lit(":"), F.left(F.sha2(fingerprint, 256), F.lit(16)))


# ---- C15: execution notes ----------------------------------------------------
def execution_notes(environment: Column, catalog: Column, schema: Column, table: Column,
                    mode: Column, sources: Column, repo: Column, branch: Column) -> Column:
    return F.concat(
        F.lit("Prepare "), environment, F.lit(" deployment for "),
        catalog, F.lit("."), schema, F.lit("."), table,
        F.lit(" using mode="), mode, F.lit(", sources="), F.array_join(sources, ","),
        F.lit(", repo="), repo, F.lit(", branch="), branch,
    )
