"""Import of answers: all checks as one aggregate, then the whole batch or nothing.

A batch's rows are staged as files of their own and count only through a manifest entry, which is one small file
renamed into its place without overwriting. A reader sees whole batches; what a failed or repeated attempt has staged is
never read; importing the same batch again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinlode.functions.canonical import canonical_id, parsed, text_at
from veinlode.operators.reviews import GateError, candidate_errors, require_none
from veinlode.operators.tables import settled

#: The fields that a candidate may have, and the properties of technical facts of a statement.
FIELDS = (
    "fact_type", "entity_name", "property_name", "property_value", "source_entity", "relation_type", "target_entity", "domain_entity", "technical_object", "mapping_type", "conflict_type", "subject",
    "left_value", "right_value", "question_type", "question_text",
)
PROPERTIES = ("assignment_expression", "assigned_value", "row_selection_expression")


def answers(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(line, text) to the candidates (line, candidate_id, record_type, ...) and the errors (line, reason); blank
    lines are passed over."""
    df = settled(lines.where(F.col("text").rlike(r"\S")).withColumn("v", parsed(F.col("text"))))
    good = F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT")
    own = ("candidate_id", "record_type", "assertion_type", "confidence", "source_revision_id", "evidence_text")
    evidence = text_at(F.col("v"), "$.evidence_id", "$.fragment_id", "$.chunk_id")
    attributes = F.map_filter(F.create_map(*[x for f in FIELDS for x in (F.lit(f), text_at(F.col("v"), f"$.{f}"))]), lambda _, v: v.isNotNull())
    rows = df.where(good).select("line", *[text_at(F.col("v"), f"$.{c}").alias(c) for c in own], evidence.alias("evidence_id"), attributes.alias("attributes"), F.to_json("v").alias("payload"))
    return rows, df.where(~F.coalesce(good, F.lit(False))).select("line", F.lit("invalid_jsonl").alias("reason"))


def already_derived(rows: DataFrame, derived: DataFrame) -> DataFrame:
    """Answers about a component (evidence_id, entity_name, property_name) that is derived already; nulls are equal."""
    of = lambda c: F.to_json(F.array(*c))
    key = of([F.col("evidence_id"), F.try_element_at("attributes", F.lit("entity_name")), F.try_element_at("attributes", F.lit("property_name"))])
    known = derived.select(of([F.col("evidence_id"), F.col("entity_name"), F.col("property_name")]).alias("component")).distinct()
    return rows.withColumn("component", key).join(known, "component", "left_semi").select("line", F.lit("deterministic_component_already_present").alias("reason"))


def contract_errors(rows: DataFrame) -> DataFrame:
    """Technical facts of statements: the properties that there are, a dotted name, a value that is its right side, and
    one property for each assignment."""
    get = lambda k: F.try_element_at("attributes", F.lit(k))
    prop, entity, value = get("property_name"), get("entity_name"), get("property_value")
    slot = prop.isin(PROPERTIES[0], PROPERTIES[1])
    column = F.regexp_extract(entity, r"\.\s*([^.]*?)\s*$", 1)
    starts = F.startswith(F.lower(F.regexp_replace(value, r"^\s+", "")), F.lower(column)) & F.regexp_replace(F.substring(F.regexp_replace(value, r"^\s+", ""), F.length(column) + 1, F.length(value)), r"^\s+", "").startswith("=")
    wrong = (
        (F.col("record_type") != "candidate_fact") | (F.coalesce(get("fact_type"), F.lit("")) != "technical") | ~F.coalesce(prop.isin(*PROPERTIES), F.lit(False))
        | (slot & (~F.coalesce(F.contains(entity, F.lit(".")), F.lit(False)) | (F.coalesce(F.trim(value), F.lit("")) == "")))
        | ((prop == PROPERTIES[0]) & F.coalesce(starts, F.lit(False))) | ((prop == PROPERTIES[1]) & F.coalesce(F.trim(value).rlike(r"(?s)^'.*'$"), F.lit(False)))
    )
    single = rows.where(wrong).select("line")
    slots = rows.where(slot).select("evidence_id", F.lower(entity).alias("entity"), prop.alias("prop"))
    both = slots.groupBy("evidence_id", "entity").agg(F.min("prop").alias("lo"), F.max("prop").alias("hi")).where("lo <> hi")
    own = rows.where(slot).select("line", "evidence_id", F.lower(entity).alias("entity"))
    twice = own.join(both, own["evidence_id"].eqNullSafe(both["evidence_id"]) & own["entity"].eqNullSafe(both["entity"]), "left_semi").select("line")
    return single.unionByName(twice).distinct().select("line", F.lit("ai_contract").alias("reason"))


def import_errors(lines: DataFrame, package: DataFrame, current: DataFrame, evidence: DataFrame, derived: DataFrame, statements: bool = False) -> tuple[DataFrame, DataFrame]:
    """lines(line, text) against package(evidence_id), current(evidence_id), evidence(evidence_id, revision_id, text)
    and derived(evidence_id, entity_name, property_name): the candidates, and every reason (line, reason) against the
    batch, line null for reasons against all of it."""
    rows, bad = answers(lines)
    fields = candidate_errors(rows, evidence).join(rows.select("candidate_id", "line"), "candidate_id").select("line", "reason").distinct()
    outside = rows.where("evidence_id is not null").join(package, "evidence_id", "left_anti").select("line", F.lit("evidence_not_in_package").alias("reason"))
    temporal = rows.where("record_type = 'temporal_interval'").select("line", F.lit("ai_temporal_forbidden").alias("reason"))
    stale = package.join(current, "evidence_id", "left_anti").limit(1).select(F.lit(None).cast("long").alias("line"), F.lit("stale_package").alias("reason"))  # one is enough
    errors = [bad, fields, outside, temporal, stale, already_derived(rows, derived)] + ([contract_errors(rows)] if statements else [])
    out = errors[0]
    for e in errors[1:]:
        out = out.unionByName(e)
    return rows, out


class Batches:
    """Imported batches under a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self) -> list[str]:
        """Batches that count, in the order of their names; one small file each."""
        fs, p = self._at("manifest")
        return sorted(f.getPath().getName() for f in fs.listStatus(p) if not f.getPath().getName().startswith(".")) if fs.exists(p) else []

    def commit(self, batch: str, rows: DataFrame, errors: DataFrame) -> bool:
        """Import ``rows`` as ``batch`` if there are no ``errors``; false if that batch is there already."""
        fs, final = self._at(f"manifest/{batch}")
        if fs.exists(final):
            return False
        require_none(errors)
        folder = f"{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{folder}")
        _, draft = self._at(f"drafts/{folder}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"folder": folder}).encode()))
        out.close()
        fs.mkdirs(final.getParent())
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # fails if it is there
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), keep)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):  # another writer was first
                return False
            raise GateError("batch_not_committed", 1) from e
        return True

    def read(self) -> DataFrame | None:
        """The rows of all batches with ``batch``; None without one."""
        out = None
        for name in self.names():
            fs, p = self._at(f"manifest/{name}")
            stream = fs.open(p)
            entry = json.loads(bytes(stream.readAllBytes()))
            stream.close()
            own = self.spark.read.parquet(f"{self.path}/data/{entry['folder']}").withColumn("batch", F.lit(name))
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out


def batch_id(origin: Column, payload: Column) -> Column:
    """Id of one candidate of a batch."""
    return canonical_id(F.lit("CAND"), F.to_json(F.array(origin, payload)))


def import_batch(store: Batches, origin: str, rows: DataFrame, errors: DataFrame) -> bool:
    """Candidates of an origin (a package and its response, by their hashes) with their ids, all or none."""
    made = rows.withColumn("imported_id", batch_id(F.lit(origin), F.col("payload")))
    return store.commit(origin, made.drop("attributes"), errors)
