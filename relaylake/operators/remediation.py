"""Remediation batch: failure context, failure labels, repository patches
and the per-run report (C18-C21, E9, F6, F7, W5, W6, S3, S4, U1-U5, G9, P5).

Batch semantics: every failed run is evaluated against the same snapshot
of its repository (a proposal per run; runs do not see each other's edits).

Scale: no step pairs every run with every file of its repository, and none
keeps only the first files. Notebook and ETL patches depend only on file
content, so they are computed once per file and counted per repository. SQL
candidates depend on the run's target names; "file contains name" is answered
by an equi-join of each name's rarest gram with the grams of the repository's
distinct identifier tokens, confirmed on the token (exact for identifier names,
intermediate rows linear in the text and the names). Paths are chosen first;
contents are read once for each patched file.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.functions import text as T
from relaylake.session import stored

LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
ENCODING_COOKIE = r"^[ \t]*#.*coding[:=][ \t]*[-\w.]+"
ETL_MODE = r'(\.mode\(\s*"(?:append|overwrite)"\s*\)\s*)(?!\s*\.\s*option\(\s*"mergeSchema")'
SQL_NAMESPACE_CHECK = "create schema if not exists"


# ---- C18 / C19 ----------------------------------------------------------------
def failure_context(status: Column, logs_url: Column, log_body: Column, run_id: Column,
                    max_chars: int | None = None) -> Column:
    """C18: '' for a successful run; a note when there is no logs URL; else
    the log body, or with ``max_chars`` its first characters."""
    body = F.coalesce(log_body, F.lit(""))
    ok = F.lower(status).isin(*K.PROMOTABLE_STATUSES)
    return (F.when(ok, F.lit(""))
            .when(F.coalesce(logs_url, F.lit("")) == "",
                  F.concat(F.lit("No logs URL available for failed run_id="), run_id.cast("string"), F.lit(".")))
            .otherwise(body if max_chars is None else F.left(body, F.lit(max_chars))))


def with_labels(runs: DataFrame, context: str = "failure_context") -> DataFrame:
    """Multi-label failure signature, lower-case substring tests."""
    c = F.lower(F.col(context))
    return runs.withColumns({
        "notebook_hint": T.contains_any(c, K.NOTEBOOK_HINTS),
        "sql_hint": T.contains_any(c, K.SQL_HINTS),
        "etl_hint": T.contains_any(c, K.ETL_HINTS),
    })


def enabled_plugins(configured: list[str]) -> list[str]:
    """Fixed plugin order whatever the configured order; names match
    case-insensitively."""
    wanted = {p.strip().lower() for p in configured}
    return [p for p in K.PLUGIN_ORDER if p in wanted]


# ---- F6 / S4 / W5 / W6 / S3: candidate files ---------------------------------
def path_parts(path: Column) -> Column:
    return F.split(F.lower(path), "/")


def etl_candidate(path: Column) -> Column:
    """A .py file under etl/pipelines/jobs/notebooks and not under
    tests/generated_changes/transformers (any path part, case-insensitive)."""
    parts = path_parts(path)
    return (path.endswith(".py")
            & ~F.arrays_overlap(parts, T.str_array(K.ETL_EXCLUDED_PARTS))
            & F.arrays_overlap(parts, T.str_array(K.ETL_INCLUDED_PARTS)))


def notebook_pattern_rank(path: Column) -> Column:
    """0 for notebooks/**/*.py, 1 for **/*notebook*.py, NULL otherwise;
    a file matching both keeps the first pattern."""
    name = F.element_at(F.split(path, "/"), -1)
    return (F.when(path.startswith("notebooks/") & path.endswith(".py"), F.lit(0))
            .when(name.like("%notebook%.py"), F.lit(1)))


def first_of_each(rows: DataFrame, keys: list[str], order: list[str], limit: int | None) -> DataFrame:
    """The first ``limit`` rows of each key, all of them without a limit.
    Spark keeps at most ``limit`` rows a key and task before the shuffle."""
    if limit is None:
        return rows
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def notebook_candidates(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Notebook files, each once, with the pattern that found it first; with
    ``limit`` so many of each repository, by pattern, then path."""
    found = files.withColumn("pattern_rank", notebook_pattern_rank(F.col("path"))).where(F.col("pattern_rank").isNotNull())
    return first_of_each(found, ["repo"], ["pattern_rank", "path"], limit)


def etl_candidates(files: DataFrame, limit: int | None = None) -> DataFrame:
    """ETL files; with ``limit`` so many of each repository, by path."""
    return first_of_each(files.where(etl_candidate(F.col("path"))), ["repo"], ["path"], limit)


# ---- U2: notebook patch --------------------------------------------------------
def split_lines(content: Column) -> Column:
    """Python's splitlines(): no trailing empty element after a final break."""
    parts = F.split(content, LINE_BREAKS, -1)
    ends = content.rlike("(" + LINE_BREAKS + ")$")
    return F.when(content == "", F.array().cast("array<string>")) \
        .when(ends, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def notebook_patch(content: Column) -> Column:
    """Insert the session bootstrap and the auto-merge setting after the
    shebang / encoding line and the leading import run (blank lines are
    skipped; any other line ends the run). Files already carrying the
    setting are returned unchanged."""
    patched = T.let(split_lines(content), lambda lines: _bootstrapped(content, lines))
    return F.when(content.contains(K.NOTEBOOK_CONF_LINE), content).otherwise(patched)


def _bootstrapped(content: Column, lines: Column) -> Column:
    n = F.size(lines)
    shebang = F.when((n > 0) & F.get(lines, 0).startswith("#!"), F.lit(1)).otherwise(F.lit(0))
    cookie = F.coalesce(F.get(lines, shebang).rlike(ENCODING_COOKIE), F.lit(False))
    header = shebang + F.when((n > shebang) & cookie, F.lit(1)).otherwise(F.lit(0))

    def insert_at(header_end: Column) -> Column:
        body = F.slice(lines, header_end + 1, F.greatest(n - header_end, F.lit(0)))
        init = F.struct(header_end.alias("at"), header_end.alias("i"), F.lit(False).alias("stop"))
        return F.aggregate(body, init, lambda acc, line: T.let(T.strip(line), lambda x: step(acc, x)))["at"]

    def step(acc: Column, line: Column) -> Column:
        is_import = line.startswith("import ") | line.startswith("from ")
        after = acc["i"] + 1
        return F.struct(F.when(~acc["stop"] & is_import, after).otherwise(acc["at"]).alias("at"), after.alias("i"),
                        (acc["stop"] | (~is_import & (line != ""))).alias("stop"))

    def merged(at: Column) -> Column:
        snippet = F.concat(T.str_array(["", K.NOTEBOOK_MARKER] + K.NOTEBOOK_BOOTSTRAP + [K.NOTEBOOK_CONF_LINE]),
                           F.when((n > 0) & (T.strip(F.get(lines, n - 1)) != ""), T.str_array([""]))
                           .otherwise(T.empty_str_array()))
        return F.concat(F.slice(lines, 1, at), snippet, F.slice(lines, at + 1, F.greatest(n - at, F.lit(0))))

    text = F.array_join(T.let(T.let(header, insert_at), merged), "\n")
    return F.concat(text, F.when(content.endswith("\n"), F.lit("\n")).otherwise(F.lit("")))


# ---- U3: ETL patch -------------------------------------------------------------
def etl_patch(content: Column) -> Column:
    """Add ``.option("mergeSchema", "true")`` after the first
    ``.mode("append"|"overwrite")`` that is not already followed by it.
    ``regexp_replace`` replaces every match, so the pattern is anchored to
    the start with a lazy prefix: only the first match is rewritten."""
    first_only = r"(?s)^(.*?)" + ETL_MODE
    return F.regexp_replace(content, first_only, r'$1$2.option("mergeSchema", "true")')


@dataclass(frozen=True)
class FilePlugin:
    """A transformer that rewrites files one by one. ``hints``: lower-case
    phrases of a failure it answers; ``candidates``: its files; ``patch``: the
    new content (equal to the old one where there is nothing to do)."""

    name: str
    hints: tuple[str, ...]
    candidates: Callable[[DataFrame], DataFrame]
    patch: Callable[[Column], Column]


FILE_PLUGINS = (FilePlugin("databricks_notebook", tuple(K.NOTEBOOK_HINTS), notebook_candidates, notebook_patch),
                FilePlugin("python_etl", tuple(K.ETL_HINTS), etl_candidates, etl_patch))


def repo_patches(files: DataFrame, plugins: Sequence[FilePlugin] = FILE_PLUGINS) -> DataFrame:
    """Patches by file plugins (run-independent), one row per changed file:
    repo, plugin, path, content."""
    out = None
    for p in plugins:
        patched = p.candidates(files).withColumn("patched", p.patch(F.col("content"))).where(F.col("patched") != F.col("content"))
        patched = patched.select("repo", F.lit(p.name).alias("plugin"), "path", F.col("patched").alias("content"))
        out = patched if out is None else out.unionByName(patched)
    return out


# ---- E9 / F7 / U4: SQL candidates and patch ----------------------------------
GRAM_SIZES = (16, 8, 4, 2, 1)  # characters; a name is looked up by grams of the largest size that fits


def grams_of(text: Column, size: Column) -> Column:
    """All substrings of ``size`` characters, each once; none if it is shorter."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))) \
        .otherwise(T.empty_str_array())


def name_candidates(vocabulary: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, name, token): the tokens that hold the name's rarest gram.

    A name of 9 characters or more is at most twice as long as its grams (up to
    32 characters), so what tells it from other names lies in one of them, and
    few tokens hold that one, whatever prefix or suffix all names share. How many
    tokens hold a gram is counted for the grams of names only; a name with a
    gram that no token holds has no hit. ``vocabulary``: repo, token, distinct."""
    size = F.coalesce(*[F.when(F.length("name") >= n, F.lit(n)) for n in GRAM_SIZES])
    wanted = names.where(F.col("name") != "").select("repo", "name").distinct().withColumn("size", size)
    used = wanted.agg(F.collect_set("size").alias("sizes"))  # one row of at most five numbers
    in_names = wanted.select("repo", "name", F.explode(grams_of(F.col("name"), F.col("size"))).alias("gram"))
    in_tokens = vocabulary.crossJoin(F.broadcast(used)).select("repo", "token", F.explode(F.flatten(F.transform(
        "sizes", lambda n: grams_of(F.col("token"), n)))).alias("gram"))
    counts = (in_tokens.join(in_names.select("repo", "gram").distinct(), ["repo", "gram"])
              .groupBy("repo", "gram").agg(F.count(F.lit(1)).alias("n")))
    rarest = (in_names.join(counts, ["repo", "gram"], "left").groupBy("repo", "name")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).where("least.n > 0"))
    return in_tokens.join(rarest.select("repo", "name", F.col("least.gram").alias("gram")), ["repo", "gram"]).select("repo", "name", "token")


def name_hits(sql_files: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, name, path) for every SQL file that contains the name
    (identifier characters, lower case). ``names``: repo, name."""
    tokens = sql_files.select("repo", "path", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower(F.col("content")), F.lit(r"([a-z0-9_]+)"), 1))).alias("token"))
    in_token = name_candidates(tokens.select("repo", "token").distinct(), names).where(F.col("token").contains(F.col("name")))
    return in_token.join(tokens, ["repo", "token"]).select("repo", "name", "path").distinct()


def sql_targets(sql_files: DataFrame, keys: DataFrame, limit: int | None = None) -> DataFrame:
    """U4: for each (repo, target_schema, target_table) the file to patch: the
    first by path, of those that contain the table or schema name (of all if
    none does), that lacks the namespace bootstrap; null ``path`` if none lacks.
    With ``limit`` only so many of them, by path, are looked at (W5).

    A file has the bootstrap if it creates a schema and names this one, so it
    is settled by the same hits; contents take no part. The keys, one for many
    tickets, and their hits are written once, as several branches start from them.
    """
    if limit is not None:
        return limited_sql_targets(sql_files, keys, limit)
    keys = stored(keys.select("repo", "target_schema", "target_table").distinct(), "sql-keys").withColumns(
        {"schema_name": F.lower("target_schema"), "table_name": F.lower("target_table")})
    names = keys.select("repo", F.explode(F.array("schema_name", "table_name")).alias("name"))
    files = sql_files.select("repo", "path", F.lower("content").contains(SQL_NAMESPACE_CHECK).alias("creates"))
    hits = stored(name_hits(sql_files, names).join(files, ["repo", "path"]), "sql-hits")
    per_name = hits.groupBy("repo", "name").agg(F.min(F.when(~F.col("creates"), F.col("path"))).alias("bare"))
    schema = per_name.select("repo", F.col("name").alias("schema_name"), F.lit(True).alias("schema_hit"), F.col("bare").alias("schema_bare"))
    table = per_name.select("repo", F.col("name").alias("table_name"), F.lit(True).alias("table_hit"), F.col("bare").alias("table_bare"))
    # files that create some schema, name the table but not this schema
    creating = hits.where("creates").select("repo", F.col("name").alias("table_name"), "path")
    naming = hits.where("creates").select("repo", F.col("name").alias("schema_name"), "path")
    other = (keys.join(creating, ["repo", "table_name"]).join(naming, ["repo", "schema_name", "path"], "left_anti")
             .groupBy("repo", "target_schema", "target_table").agg(F.min("path").alias("other_bare")))
    first = files.groupBy("repo").agg(F.min("path").alias("first_path"))
    joined = (keys.join(schema, ["repo", "schema_name"], "left").join(table, ["repo", "table_name"], "left")
              .join(other, ["repo", "target_schema", "target_table"], "left").join(first, "repo", "left"))
    hit = F.coalesce("schema_hit", F.lit(False)) | F.coalesce("table_hit", F.lit(False))
    return joined.select("repo", "target_schema", "target_table",
                         F.when(hit, F.least("schema_bare", "table_bare", "other_bare")).otherwise(F.col("first_path")).alias("path"))


def limited_sql_targets(sql_files: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """``sql_targets`` over the first ``limit`` files of each key. The first of
    a key are among the first of its two names, so a key meets 2 x ``limit``
    files at most."""
    keys = stored(keys.select("repo", "target_schema", "target_table").distinct(), "sql-keys").withColumns(
        {"schema_name": F.lower("target_schema"), "table_name": F.lower("target_table")})
    by = ["repo", "target_schema", "target_table"]
    files = sql_files.select("repo", "path", F.lower("content").contains(SQL_NAMESPACE_CHECK).alias("creates"))
    names = keys.select("repo", F.explode(F.array("schema_name", "table_name")).alias("name"))
    hits = stored(name_hits(sql_files, names).join(files, ["repo", "path"]), "sql-hits")
    top = first_of_each(hits, ["repo", "name"], ["path"], limit)
    found = [keys.join(top.withColumnRenamed("name", column), ["repo", column]).select(*by, "schema_name", "path", "creates")
             for column in ("schema_name", "table_name")]
    looked = first_of_each(found[0].unionByName(found[1]).distinct(), by, ["path"], limit)
    naming = hits.select("repo", F.col("name").alias("schema_name"), "path", F.lit(True).alias("names"))
    looked = looked.join(naming, ["repo", "schema_name", "path"], "left")
    bare = looked.groupBy(*by).agg(F.lit(True).alias("hit"), F.min(F.when(~(F.col("creates") & F.coalesce("names", F.lit(False))), F.col("path"))).alias("bare"))
    first = files.groupBy("repo").agg(F.min("path").alias("first_path"))
    joined = keys.select(*by).join(bare, by, "left").join(first, "repo", "left")
    return joined.select(*by, F.when(F.col("hit"), F.col("bare")).otherwise(F.col("first_path")).alias("path"))


def sql_block(catalog: Column, schema: Column) -> Column:
    return F.concat(F.lit(K.SQL_MARKER + "\n"), F.lit("CREATE CATALOG IF NOT EXISTS "), catalog, F.lit(";\n"),
                    F.lit("CREATE SCHEMA IF NOT EXISTS "), catalog, F.lit("."), schema, F.lit(";\n\n"))


def has_bootstrap(content: Column, schema: Column) -> Column:
    """F7 (SQL): the file already creates the schema and refers to it.
    Every accepted spelling of the reference contains the schema name."""
    low = F.lower(content)
    return low.contains(SQL_NAMESPACE_CHECK) & (F.lower(schema) != "") & low.contains(F.lower(schema))


def sql_patches(runs: DataFrame, sql_files: DataFrame) -> DataFrame:
    """U4 per run: the path of the file that gets the namespace block, or of a
    new file ``sql/remediation_bootstrap_wi_<id>.sql`` where no file lacks it."""
    keys = ["repo", "target_schema", "target_table"]
    j = runs.join(sql_targets(sql_files, runs.select(*keys)), keys, "left")
    generated = F.concat(F.lit("sql/remediation_bootstrap_wi_"), F.col("work_item_id").cast("string"), F.lit(".sql"))
    return j.select("run_id", "repo", "target_catalog", "target_schema", F.coalesce(F.col("path"), generated).alias("sql_path"),
                    F.col("path").isNull().alias("sql_generated"))


def sql_patched_files(patches: DataFrame, sql_files: DataFrame) -> DataFrame:
    """U4: one row per written file (repo, target_catalog, target_schema,
    sql_path, content): the block, before the file's content if it exists."""
    wanted = patches.select("repo", "target_catalog", "target_schema", "sql_path", "sql_generated").distinct()
    block = sql_block(F.col("target_catalog"), F.col("target_schema"))
    body = F.when(F.col("sql_generated"), F.lit("")).otherwise(F.coalesce("content", F.lit("")))
    return (wanted.join(sql_files.select("repo", F.col("path").alias("sql_path"), "content"), ["repo", "sql_path"], "left")
            .select("repo", "target_catalog", "target_schema", "sql_path", F.concat(block, body).alias("content")))


# ---- G9 / U5 / P5 -----------------------------------------------------------
def remediation_report(runs: DataFrame, files: DataFrame, plugins: list[str] | None = None,
                       allow_fallback: bool = True, attempt: Column | None = None,
                       extra: Sequence[FilePlugin] = ()) -> DataFrame:
    """P5: per failed run — labels, the plugins that changed files, the report
    text and the remediation outcome. The files themselves are the rows of
    ``repo_patches`` and ``sql_patched_files``; a run's detail has their number
    (a repository may have any number of them).

    ``runs`` needs run_id, work_item_id, environment, status, logs_url,
    log_body, repo, target_catalog, target_schema, target_table. ``plugins``
    names the built-in ones to use; ``extra`` are a user's own, after them.
    """
    active = enabled_plugins(plugins if plugins is not None else K.PLUGIN_ORDER)
    by_name = {p.name: p for p in (*FILE_PLUGINS, *extra)}
    used = [*active, *[p.name for p in extra]]
    r = runs.withColumn("failure_context", failure_context(F.col("status"), F.col("logs_url"), F.col("log_body"),
                                                           F.col("run_id")))
    r = with_labels(r).where(~F.lower(F.col("status")).isin(*K.PROMOTABLE_STATUSES))
    on_files = [by_name[n] for n in used if n in by_name]
    if on_files:
        per_repo = repo_patches(files, on_files).groupBy("repo").pivot("plugin", [p.name for p in on_files]).count()
        r = r.join(per_repo, "repo", "left")
    if "sql" in active:
        chosen = sql_patches(r.where(F.col("sql_hint")), files.where(F.col("path").endswith(".sql")))
        r = r.join(chosen.select("run_id", F.lit(1).cast("long").alias("sql")), "run_id", "left")
    context = F.lower(F.col("failure_context"))
    counts = []
    for name in used:
        hinted = F.col("sql_hint") if name == "sql" else T.contains_any(context, list(by_name[name].hints))
        counts.append((name, F.when(hinted, F.coalesce(F.col(f"`{name}`"), F.lit(0))).otherwise(F.lit(0)).cast("long")))
    entries = F.array_compact(F.array(F.lit(None).cast("string"), *[
        F.when(n > 0, F.concat(F.lit(f"{name}:"), n.cast("string"), F.lit(" file(s)"))) for name, n in counts]))
    changed = sum((n for _, n in counts), F.lit(0))
    summary = F.when(F.size(entries) > 0, F.array_join(entries, ", ")).otherwise(F.lit(K.NO_PLUGIN_TEXT))
    att = attempt if attempt is not None else F.lit(1)
    artifact = F.concat(F.lit("generated_changes/remediation_"), F.col("work_item_id").cast("string"), F.lit("_"),
                        F.col("environment"), F.lit("_attempt_"), att.cast("string"), F.lit(".md"))
    changed_any = F.size(entries) > 0
    status = F.when(changed_any | F.lit(allow_fallback), F.lit("succeeded")).otherwise(F.lit("failed"))
    detail = (F.when(changed_any, F.concat(F.lit("transformers="), summary, F.lit("; changed_files="), changed.cast("string")))
              .when(F.lit(allow_fallback), F.concat(F.lit("remediation_artifact="), artifact))
              .otherwise(F.lit("No remediation transformers applied and fallback artifact is disabled.")))
    return r.select("run_id", "work_item_id", "environment", "repo", "notebook_hint", "sql_hint", "etl_hint",
                    summary.alias("report"), status.alias("remediation_status"), detail.alias("remediation_detail"))
