"""Prompt-template rendering as Column expressions.

A template is split once into its literal parts and its ``{field}`` names;
the output interleaves the parts with the values looked up in a per-row
map. This is a single pass, like Python's ``str.format`` (a value that
itself contains ``{x}`` is not expanded again). A template with a field the
context lacks, or an empty template, yields the fallback text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.functions import text as T

FIELD = r"\{[A-Za-z0-9_]+\}"
FIELD_NAME = r"\{([A-Za-z0-9_]+)\}"


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """A10: (name, template) rows; a handful of rows, broadcast on use."""
    t = K.TEMPLATES if templates is None else templates
    return spark.createDataFrame(sorted(t.items()), "name string, template string")


def split_template(template: Column) -> tuple[Column, Column]:
    """The ``{field}`` names of a template and the literal parts around them."""
    return F.regexp_extract_all(template, F.lit(FIELD_NAME), 1), F.split(template, FIELD, -1)


def filled(template: Column, keys: Column, parts: Column, context: dict[str, Column], fallback: Column) -> Column:
    """C20 with the template's ``keys`` and ``parts`` given. The values are put
    into a map once a row, not at each field."""
    ctx = F.create_map(*[x for k, v in context.items() for x in (F.lit(k), v.cast("string"))])
    missing = F.exists(keys, lambda k: ~F.array_contains(T.str_array(list(context)), k)) if context else F.size(keys) > 0
    texts = T.let(ctx, lambda c: F.array_join(F.transform(keys, lambda k, i: F.concat(F.get(parts, i), F.try_element_at(c, k))), ""))
    body = F.concat(texts, F.get(parts, F.size(keys)))
    return F.when(template.isNull() | (template == "") | missing, fallback).otherwise(body)


def render(template: Column, context: dict[str, Column], fallback: Column) -> Column:
    """C20: ``template.format(**context)`` or ``fallback``."""
    return filled(template, *split_template(template), context, fallback)


def render_by_name(df: DataFrame, templates: DataFrame, name_col: str, context: dict[str, Column],
                   fallback: Column, out: str) -> DataFrame:
    """Render, for every row, the template named in ``name_col``.

    Equi-join on the template name; the template table is a fixed handful of
    rows, so it is broadcast, split into fields and parts already. A name with
    no template renders the fallback.
    """
    keys, parts = split_template(F.col("template"))
    t = templates.select(F.col("name").alias("_tname"), F.col("template").alias("_tpl"), keys.alias("_keys"), parts.alias("_parts"))
    joined = df.join(F.broadcast(t), df[name_col] == t["_tname"], "left")
    return joined.withColumn(out, filled(F.col("_tpl"), F.col("_keys"), F.col("_parts"), context, fallback)).drop("_tname", "_tpl", "_keys", "_parts")


def literal(name: str) -> Column:
    """The template text itself as a literal (when the table is static)."""
    return F.lit(K.TEMPLATES.get(name, ""))


def python_list(arr: Column) -> Column:
    """How a list of strings prints through ``str.format``: ['a', 'b']."""
    return F.concat(F.lit("['"), F.array_join(arr, "', '"), F.lit("']"))
