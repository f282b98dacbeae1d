"""Configured fields: rules, requests to a model, its answers, and exports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..stored import settled
from .links import components
from .ranges import PIECE_ROWS, carried, ranged, with_carried

Field = dict[str, str]


def _context(field: Field) -> str:
    """The field's keywords as one literal alternation."""
    words = [re.sub(r"\\(.)", r"\1", w) for w in field.get("context", "").split("|") if w]
    return "|".join(re.escape(w) for w in words)


def extract_fields(docs: DataFrame, fields: list[Field] | None = None, column: str = "text") -> DataFrame:
    """One row per document and field: the value behind a keyword, else the first hit of the field's pattern, else null."""
    text, rows = F.coalesce(F.col(column), F.lit("")), []
    for field in fields or fixed.DEFAULT_FIELDS:
        shape, near = field.get("regex") or r"([^\n]+)", _context(field)
        shape = shape if "(" in shape else f"({shape})"
        value = F.lit(None).cast("string")
        if near:
            value = F.nullif(F.regexp_extract(text, rf"(?U)(?:{near})\s*[:：]?\s*(?:{shape})", 1), F.lit(""))
        if field.get("regex"):
            value = F.coalesce(value, F.nullif(F.regexp_extract(text, f"(?U){shape}", 1), F.lit("")))
        rows.append(F.struct(F.lit(field["name"]).alias("field_name"), F.lit(field["type"]).alias("field_type"), F.trim(value).alias("value")))
    return docs.select("doc_id", F.inline(F.array(*rows)))


def field_description(fields: list[Field]) -> str:
    out = []
    for k, field in enumerate(fields, 1):
        kind = field.get("type") or "text"
        line = f"{k}. {field['name']} (Type: {kind})"
        near = ", ".join(f'"{word}"' for word in (field.get("context") or "").split("|"))
        line += fixed.REQUEST_CONTEXT.format(near) if field.get("context") else ""
        line += fixed.REQUEST_PATTERN.format(field["regex"]) if field.get("regex") else ""
        out.append(line + fixed.REQUEST_HINTS.get(kind, ""))
    return "\n\n".join(out)


def build_requests(docs: DataFrame, fields: list[Field] | None = None, column: str = "text", lang: str = "lang") -> DataFrame:
    """One prompt per document; the description of the fields is one literal."""
    order = F
    for code, words in fixed.REQUEST_INSTRUCTIONS.items():
        order = order.when(F.col(lang) == code, words)
    order = order.otherwise(fixed.REQUEST_INSTRUCTIONS["eng"])
    fields_text = fixed.REQUEST_FIELDS + field_description(fields or fixed.DEFAULT_FIELDS) + fixed.REQUEST_RULES
    prompt = F.concat(F.lit(fixed.REQUEST_TITLE), order, F.lit(fields_text), F.coalesce(F.col(column), F.lit("")), F.lit(fixed.REQUEST_ANSWER))
    return docs.select("doc_id", prompt.alias("prompt"))


def _body(response: Column) -> Column:
    fenced = F.regexp_extract(response, r"(?s)```json(.*?)```", 1)
    bare = F.regexp_extract(response, r"(?s)```(.*?)```", 1)
    return F.trim(F.when(fenced != "", fenced).when(bare != "", bare).otherwise(response))


def parse_responses(responses: DataFrame, fields: list[Field] | None = None, column: str = "response") -> tuple[DataFrame, DataFrame]:
    """(doc_id, field_name, field_type, value_string, value_double) and the rows that are no JSON object.

    Amounts written as text keep their digits and dots; numbers stay as they are.
    """
    body = responses.withColumn("_v", F.try_parse_json(_body(F.coalesce(F.col(column), F.lit("")))))
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    rows = []
    for field in fields or fixed.DEFAULT_FIELDS:
        path = f"$.{field['name']}"
        text = F.try_variant_get("_v", path, "string")
        text = F.when(F.lower(F.trim(text)) == "null", None).otherwise(text)
        number = F.lit(None).cast("double")
        if field["type"] == "amount":
            written = F.schema_of_variant(F.try_variant_get("_v", path, "variant")) == "STRING"
            digits = F.regexp_replace(text, "[^0-9.]", "")
            number = F.when(written, digits.try_cast("double")).otherwise(text.try_cast("double"))
        rows.append(F.struct(F.lit(field["name"]).alias("field_name"), F.lit(field["type"]).alias("field_type"), F.trim(text).alias("value_string"), number.alias("value_double")))
    good = body.filter(is_object).select("doc_id", F.inline(F.array(*rows)))
    return good, body.filter(~is_object).select("doc_id", F.lit("no JSON object").alias("error"))


def export_rows(extracted: DataFrame, names: list[str], extras: DataFrame | None = None, extra_names: list[str] = (), bom: bool = False) -> DataFrame:
    """Wide rows: extras in front (the last one first), then the fields in their order; missing values are empty."""
    wide = extracted.groupBy("doc_id").pivot("field_name", list(names)).agg(F.first("value"))
    extra_names = list(extra_names)
    if extras is not None:
        wide = wide.drop(*[n for n in extra_names if n in names]).join(extras.select("doc_id", *[n for n in extra_names if n != "doc_id"]), "doc_id", "left")
    columns = [*reversed(extra_names), *[n for n in names if n not in extra_names]]
    out = wide.select(*[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")).alias(n) for n in columns])
    return out.withColumnRenamed(columns[0], "﻿" + columns[0]) if bom and columns else out


def write_export(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_field_template(spark, path: str) -> DataFrame:
    """Field definitions from CSV; ``name`` and ``type`` are required, empty context and regex become null."""
    raw = spark.read.option("header", True).csv(path)
    if missing := {"name", "type"} - set(raw.columns):
        raise ValueError(f"the template lacks {sorted(missing)}")
    part = lambda n: F.nullif(F.col(n), F.lit("")) if n in raw.columns else F.lit(None).cast("string")
    return raw.select("name", "type", part("context").alias("context"), part("regex").alias("regex"))


def write_field_template(fields: DataFrame, path: str) -> None:
    fields.select("name", "type", "context", "regex").write.mode("overwrite").option("header", True).csv(path)


def _epochs(changes: DataFrame) -> tuple[DataFrame, int]:
    """``changes`` without the resets, with ``epoch``: how many resets came before; and the number of resets."""
    resets = changes.filter("op = 'reset'").count()
    if not resets:
        return changes.withColumn("epoch", F.lit(0)), 0
    cut = ranged(changes, ["ord"])
    is_reset = F.count_if(F.col("op") == "reset")
    before = carried(cut, [], {"_n": is_reset}, {"_before": F.sum("_n")})
    inside = is_reset.over(Window.partitionBy("bucket").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    out = with_carried(cut.withColumn("_in", inside), before, []).withColumn("epoch", (F.coalesce("_before", F.lit(0)) + F.col("_in")).cast("int"))
    return out.filter("op <> 'reset' or op is null").drop("bucket", "_in", "_before"), resets


def _later(epoch: str = "epoch") -> Column:
    """Whether an epoch starts from the defaults; the first one starts from the fields."""
    return F.col(epoch) > 0


def _judged(changes: DataFrame, base: DataFrame, limit: int) -> DataFrame:
    """Changes of names that no rename ties to others, with ``_ok``; ``base`` has what is there at the start (later, name, type).

    Whether a name is there follows from the last add or delete before, accepted or
    not: an add leaves it there, a delete does not, an update leaves it as it was.
    """
    key = ["epoch", "name"]
    most = changes.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    cut = changes.withColumn("bucket", F.lit(0)) if most <= limit else ranged(changes, [*key, "ord"])
    left = F.when(F.col("op") == "add", True).when(F.col("op") == "delete", False)
    before = carried(cut, key, {"_end": F.max_by(left, F.when(left.isNotNull(), F.col("ord")))}, {"_start": F.last("_end", ignorenulls=True)})
    inside = F.last(left, ignorenulls=True).over(Window.partitionBy(*key, "bucket").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    known = with_carried(cut.withColumn("_in", inside), before, key).withColumn("later", _later())
    known = known.join(base.select("later", "name", F.lit(True).alias("_had")), ["later", "name"], "left").drop("later")
    there = F.coalesce("_in", "_start", "_had", F.lit(False))
    ok = F.when(F.col("op") == "add", ~there).when(F.col("op").isin("update", "delete"), there)
    return known.withColumn("_ok", F.col("name").isNotNull() & F.coalesce(ok, F.lit(False)))


def _folded(changes: DataFrame, base: DataFrame, roots: DataFrame) -> DataFrame:
    """Changes and fields of names that renames tie together, in order per component: rejects, and fields at each end.

    Rows stream through a task in order; it holds the names of one component.
    """
    shape = f"epoch int, ord {changes.schema['ord'].dataType.simpleString()}, op string, name {changes.schema['name'].dataType.simpleString()}, type string, kind string"
    held = roots.withColumn("later", _later()).join(base, ["later", "name"]).select("epoch", "name", "root", "type")  # only names that change: epochs times names would grow with the square
    rows = changes.select("epoch", "ord", "op", "name", "type", "new_name").join(roots, ["epoch", "name"]).unionByName(held, allowMissingColumns=True)
    columns = ["epoch", "ord", "op", "name", "type", "kind"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}
        for batch in batches:
            out = []
            names = batch["name"].tolist()
            for name, new, root, (epoch, order, op, kind) in zip(names, batch["new_name"].tolist(), batch["root"].tolist(), batch[["epoch", "ord", "op", "type"]].itertuples(index=False, name=None), strict=True):
                if (epoch, root) != at:
                    out += [(at[0], None, None, n, t, "field") for n, t in held.items()] if at else []
                    at, held = (epoch, root), {}
                new = name if pd.isna(new) else new
                if pd.isna(order):
                    held[name] = kind
                elif op == "add" and name not in held:
                    held[name] = kind
                elif op == "update" and name in held and (new == name or new not in held):
                    del held[name]
                    held[new] = kind
                elif op == "delete" and name in held:
                    del held[name]
                else:
                    out.append((epoch, order, op, name, None, "reject"))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([(at[0], None, None, n, t, "field") for n, t in held.items()] if at else [], columns=columns)

    dealt = rows.repartition("epoch", "root").sortWithinPartitions("epoch", "root", F.col("ord").asc_nulls_first())
    return dealt.mapInPandas(walk, shape)


def apply_changes(fields: DataFrame, changes: DataFrame, defaults: DataFrame | None = None, limit: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Fields after a log of changes in the order of ``ord``, and the rejected changes.

    ``changes``: ord (unique), op (add, update, delete, reset), name, type and, for an
    update that renames, new_name.  Rejected are an add of a name that is there, an
    update or delete of one that is not, a rename onto a name that is there, unknown
    operations and changes without a name; each is judged by what the accepted ones
    before it left.  A reset puts ``defaults`` in place of all fields, so the log falls
    into epochs that are judged apart.  An update replaces the whole field.

    Names that renames tie together are folded in order per component; all others are
    judged by carries over their changes, however many one name has.
    """
    if defaults is None:
        defaults = fields.sparkSession.createDataFrame([(f["name"], f["type"]) for f in fixed.DEFAULT_FIELDS], "name string, type string")
    if "new_name" not in changes.columns:
        changes = changes.withColumn("new_name", F.lit(None).cast(changes.schema["name"].dataType))
    log, resets = _epochs(changes.select("ord", "op", "name", "type", "new_name"))
    log = settled(log, "changes")
    base = fields.select(F.lit(False).alias("later"), "name", "type").union(defaults.select(F.lit(True), "name", "type"))
    renames = log.filter((F.col("op") == "update") & (F.col("new_name") != F.col("name")))
    tied = None
    if not renames.isEmpty():
        ends = lambda n: F.struct("epoch", F.col(n).alias("name"))
        tied = components(renames.select(ends("name").alias("a"), ends("new_name").alias("b"))).select("node.epoch", "node.name", F.col("root.name").alias("root"))
        tied = settled(tied, "tied")
    alone = log.join(tied, ["epoch", "name"], "left_anti") if tied is not None else log
    judged = settled(_judged(alone, base, limit), "judged")
    final = base.filter(F.col("later") == F.lit(resets > 0)).select("name", "type")
    final = final.join(tied.filter(F.col("epoch") == resets), "name", "left_anti") if tied is not None else final
    last = judged.filter(F.col("_ok") & (F.col("epoch") == resets)).groupBy("name").agg(F.max_by(F.struct("op", "type"), "ord").alias("c"))
    out = final.join(last, "name", "full_outer").filter(F.coalesce(F.col("c.op") != "delete", F.lit(True)))
    out = out.select("name", F.when(F.col("c").isNotNull(), F.col("c.type")).otherwise(F.col("type")).alias("type"))
    bad = judged.filter(~F.col("_ok")).select("ord", "op", "name")
    if tied is not None:
        folded = settled(_folded(log, base, tied), "folded")
        out = out.union(folded.filter((F.col("kind") == "field") & (F.col("epoch") == resets)).select("name", "type"))
        bad = bad.union(folded.filter("kind = 'reject'").select("ord", "op", "name"))
    return out, bad


RESULT_SCHEMA = "file_id string, text string, confidence double, pages array<struct<page_num:int,text:string>>, entities map<string,array<string>>"


def read_results(rows: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, pages and entities of nested result JSON."""
    parsed = rows.select(F.from_json(column, RESULT_SCHEMA).alias("r")).select("r.*")
    pages = parsed.select("file_id", F.inline_outer("pages"))
    entities = parsed.select("file_id", F.explode("entities").alias("entity_type", "values")).select("file_id", "entity_type", F.explode("values").alias("value"))
    return parsed.select("file_id", "text", "confidence"), pages, entities


def first_form(fields: DataFrame) -> DataFrame:
    """Fields of the document with the smallest id of each form."""
    first = fields.groupBy("form").agg(F.min("doc_id").alias("doc_id"))
    return fields.join(first, ["form", "doc_id"]).select("form", "field_name", "field_type", "value")


def collect_export(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Results with fields of finished tasks; raises if there is none."""
    out = tasks.filter(F.col("status") == "finished").join(results.filter(F.col("fields").isNotNull()), "doc_id")
    if out.isEmpty():
        raise ValueError("no finished task has fields")
    return out
