"""A project's rows out of shared tables, and archives of them into a new project with new ids.

Tables are DataFrames by name. What belongs to a project follows from its id or from a row's owner, so the closure is a
chain of semi-joins on narrow key columns, in the order of ownership. A new id is a digest of the import's namespace, the
table and the old id: every reference is rewritten where it stands, without a join or a shuffle, equally in a task that is
run again; cycles of references are no matter. Joins are needed only to refuse an archive with open references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables in order of dependency, references by column, and lists of references.
TABLES = (
    "target_config_versions", "grader_versions", "scenario_versions", "dataset_versions", "cases", "release_policies", "runs",
    "run_candidates", "grading_runs", "trials", "attempts", "grades", "trial_outcomes", "reviews", "comparisons",
    "calibration_versions", "probability_records", "external_imports", "external_results", "artifact_refs",
)
REFERENCES = {
    "target_config_versions": {"parent_id": "target_config_versions"},
    "grader_versions": {"judge_config_id": "target_config_versions", "parent_id": "grader_versions"},
    "scenario_versions": {"parent_id": "scenario_versions"},
    "dataset_versions": {"scenario_id": "scenario_versions", "parent_id": "dataset_versions"},
    "cases": {"dataset_id": "dataset_versions"},
    "runs": {"scenario_id": "scenario_versions", "dataset_id": "dataset_versions", "parent_run_id": "runs"},
    "run_candidates": {"run_id": "runs", "target_config_id": "target_config_versions"},
    "grading_runs": {"run_id": "runs"},
    "trials": {"run_id": "runs", "case_id": "cases", "selected_attempt_id": "attempts"},
    "attempts": {"trial_id": "trials"},
    "grades": {"grading_run_id": "grading_runs", "trial_id": "trials", "grader_id": "grader_versions"},
    "trial_outcomes": {"grading_run_id": "grading_runs", "trial_id": "trials"},
    "reviews": {"trial_id": "trials", "supersedes_id": "reviews"},
    "comparisons": {"baseline_run_id": "runs", "candidate_run_id": "runs", "policy_id": "release_policies"},
    "probability_records": {"dataset_id": "dataset_versions", "case_id": "cases", "trial_id": "trials"},
    "external_results": {"import_id": "external_imports"},
}
LISTS = {
    "scenario_versions": {"grader_refs": "grader_versions"}, "grading_runs": {"grader_ids": "grader_versions"},
    "reviews": {"grade_ids": "grades"}, "comparisons": {"grading_run_ids": "grading_runs"},
}
ENTITIES = {"attempt": "attempts", "trial": "trials", "external_import": "external_imports"}
#: Whose row a table's row is, where it has no project of its own.
OWNERS = {
    "cases": "dataset_id", "run_candidates": "run_id", "grading_runs": "run_id", "trials": "run_id", "attempts": "trial_id", "grades": "grading_run_id",
    "trial_outcomes": "grading_run_id", "reviews": "trial_id", "external_results": "import_id",
}


class ArchiveError(ValueError):
    """The archive can't be imported as a whole, so nothing of it is."""


def _known(tables: dict[str, DataFrame]) -> list[str]:
    unknown = sorted(set(tables) - set(TABLES))
    if unknown:
        raise ArchiveError(f"unknown tables: {unknown}")
    return [t for t in TABLES if t in tables]


def _keys(df: DataFrame, as_name: str) -> DataFrame:
    """Ids to semi-join with, which needs them neither distinct nor in memory."""
    return df.select(F.col("id").alias(as_name)).where(F.col(as_name).isNotNull())


def closure(tables: dict[str, DataFrame], project_id: str) -> dict[str, DataFrame]:
    """The rows of one project, by table, with all of their columns. Tables that aren't given are left out; a table
    whose owner isn't given has no rows. Rows with a null owner belong to no project."""
    out: dict[str, DataFrame] = {}
    for name in _known(tables):
        df = tables[name]
        if name == "artifact_refs":
            kept = [
                df.where(F.col("entity_type") == kind).join(_keys(out[target], "entity_id"), "entity_id", "left_semi").select(*df.columns)
                for kind, target in ENTITIES.items() if target in out
            ]
            out[name] = kept[0] if kept else df.limit(0)
            for more in kept[1:]:
                out[name] = out[name].unionByName(more)
        elif name in OWNERS:
            owner = REFERENCES[name][OWNERS[name]]
            out[name] = df.join(_keys(out[owner], OWNERS[name]), OWNERS[name], "left_semi").select(*df.columns) if owner in out else df.limit(0)
        else:
            out[name] = df.where(F.col("project_id") == project_id)
    return out


def references(tables: dict[str, DataFrame]) -> DataFrame:
    """Every reference of every row: table, column, target, value; lists as one row an element, nulls and '' left out."""
    found = []
    for name in _known(tables):
        df = tables[name]
        for column, target in REFERENCES.get(name, {}).items():
            if column in df.columns:
                found.append(df.select(F.lit(name).alias("table"), F.lit(column).alias("column"), F.lit(target).alias("target"), F.col(column).alias("value")))
        for column, target in LISTS.get(name, {}).items():
            if column in df.columns:
                found.append(df.select(F.lit(name).alias("table"), F.lit(column).alias("column"), F.lit(target).alias("target"), F.explode(column).alias("value")))
        if name == "artifact_refs":
            target = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])[F.col("entity_type")]
            found.append(df.select(F.lit(name).alias("table"), F.lit("entity_id").alias("column"), target.alias("target"), F.col("entity_id").alias("value")).where("target is not null"))
    if not found:
        raise ArchiveError("no table with references")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.where("value is not null and value <> ''")


def open_references(tables: dict[str, DataFrame]) -> DataFrame:
    """References to rows that aren't there: table, column, target and how many. Values are made distinct before the join, so a
    row that a third of all rows refer to is looked up once. Each column is looked up and summed for itself, as a task of a
    union holds the memory of all its branches until it ends."""
    names, out = _known(tables), None
    found = references(tables)
    asked = {(n, c, t) for n in names for kind in (REFERENCES, LISTS) for c, t in kind.get(n, {}).items() if c in tables[n].columns}
    if "artifact_refs" in names:
        asked |= {("artifact_refs", "entity_id", t) for t in ENTITIES.values()}
    for name, column, target in sorted(asked):
        own = found.where((F.col("table") == name) & (F.col("column") == column) & (F.col("target") == target)).select(F.col("value").cast("string").alias("value"))
        counted = own.groupBy("value").agg(F.count("*").alias("n"))
        if target in names:
            counted = counted.join(tables[target].select(F.col("id").cast("string").alias("value")), "value", "left_anti")
        row = counted.agg(F.sum("n").alias("n")).where("n is not null").select(F.lit(name).alias("table"), F.lit(column).alias("column"), F.lit(target).alias("target"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def faulty_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """Ids that are null or occur more than once: table and how many rows."""
    out = None
    for name in _known(tables):
        own = tables[name].groupBy("id").agg(F.count("*").alias("n")).where("id is null or n > 1").agg(F.sum("n").alias("n")).where("n is not null").select(F.lit(name).alias("table"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def new_id(namespace: str, kind: str, old: Column) -> Column:
    """An id in the form of a UUID; null and '' stay."""
    h = F.sha2(F.concat(F.lit(f"{namespace}:{kind}:"), old), 256)
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(old == "", old).when(old.isNotNull(), F.concat_ws("-", *parts))


def id_map(tables: dict[str, DataFrame], namespace: str) -> DataFrame:
    """table, old_id and new_id of every row."""
    out = None
    for name in _known(tables):
        own = tables[name].select(F.lit(name).alias("table"), F.col("id").alias("old_id"), new_id(namespace, name, F.col("id")).alias("new_id"))
        out = own if out is None else out.unionByName(own)
    return out


def remap(tables: dict[str, DataFrame], namespace: str, project_id: str, *, checked: bool = False) -> dict[str, DataFrame]:
    """The tables of an archive as rows of a new project, under ids that no other namespace gives.

    Refused whole (``ArchiveError``) if an id is missing or repeated or a reference is open, unless that was ``checked``. Versions
    of one thing keep one logical_id, a new one. References of artifacts to entities of an unknown kind are left out.
    """
    names = _known(tables)
    if not checked:
        bad = [f"{r.table}: {r.n} rows without an id of their own" for r in faulty_ids(tables).collect()]  # a row a table
        bad += [f"{r.table}.{r.column}: {r.n} references to {r.target} that are not in the archive" for r in open_references(tables).collect()]
        if bad:
            raise ArchiveError("; ".join(sorted(bad)))
    out = {}
    for name in names:
        df = tables[name]
        changed = {"id": new_id(namespace, name, F.col("id"))}
        if "project_id" in df.columns:
            changed["project_id"] = F.lit(project_id)
        if "logical_id" in df.columns:
            changed["logical_id"] = new_id(namespace, f"{name}/logical", F.col("logical_id"))
        for column, target in REFERENCES.get(name, {}).items():
            if column in df.columns:
                changed[column] = new_id(namespace, target, F.col(column))
        for column, target in LISTS.get(name, {}).items():
            if column in df.columns:
                changed[column] = _each(column, namespace, target)
        if name == "artifact_refs":
            entity = F.lit(None).cast("string")
            for kind, target in ENTITIES.items():
                entity = F.when(F.col("entity_type") == kind, new_id(namespace, target, F.col("entity_id"))).otherwise(entity)
            df, changed["entity_id"] = df.where(F.col("entity_type").isin(*ENTITIES)), entity
        out[name] = df.withColumns(changed)
    return out


def _each(column: str, namespace: str, target: str) -> Column:
    return F.transform(column, lambda x: new_id(namespace, target, x))


def manifest_hash(tables: dict[str, DataFrame]) -> str:
    """One hash of the rows of several tables, whatever their order and partitions.

    A row's digest is that of its JSON, keys in order, nulls written; the types of columns count, so 1 and 1.0 differ. Digests are
    summed by their first byte in 16 limbs of 16 bits, which is exact and needs one small row from each task; the sums, the
    number of rows and the schema of each table are hashed in the end. Equal rows add up, so a repeated row is another manifest.
    """
    import hashlib
    import json

    told = {}
    for name in sorted(tables):
        df = tables[name].select(*sorted(tables[name].columns))
        digest = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256) if df.columns else F.lit("0" * 64)
        limbs = [F.sum(F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("long")).alias(f"l{i}") for i in range(16)]
        row = df.agg(F.count("*").alias("n"), *limbs).first()
        told[name] = {"rows": row.n, "limbs": [int(row[f"l{i}"] or 0) for i in range(16)], "schema": [[f.name, f.dataType.simpleString()] for f in df.schema]}
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables of three projects derived from events: a dataset each, a run and a case a user, a trial an event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    users = e.select("user_id").distinct()
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    third = lambda prefix: F.concat(F.lit(prefix), (F.col("user_id") % 3).cast("string"))
    earlier = F.when(F.col("user_id") % 2 == 0, named("t", "event_id"))
    return {
        "dataset_versions": users.select(third("d").alias("id"), third("p").alias("project_id"), third("logical").alias("logical_id")).distinct(),
        "cases": users.select(named("c", "user_id").alias("id"), third("d").alias("dataset_id")),
        "runs": users.select(named("r", "user_id").alias("id"), third("p").alias("project_id"), third("d").alias("dataset_id"), F.when(F.col("user_id") % 2 == 0, named("r", "user_id")).alias("parent_run_id")),
        "grading_runs": users.select(named("g", "user_id").alias("id"), named("r", "user_id").alias("run_id")),
        "trials": e.select(named("t", "event_id").alias("id"), named("r", "user_id").alias("run_id"), named("c", "user_id").alias("case_id"), F.when(F.col("event_type") != "error", named("a", "event_id")).alias("selected_attempt_id")),
        "attempts": e.select(named("a", "event_id").alias("id"), named("t", "event_id").alias("trial_id")),
        "grades": e.where("event_type <> 'error'").select(named("h", "event_id").alias("id"), named("g", "user_id").alias("grading_run_id"), named("t", "event_id").alias("trial_id")),
        "reviews": e.where("event_type = 'purchase'").select(named("v", "event_id").alias("id"), named("t", "event_id").alias("trial_id"), F.array(named("h", "event_id")).alias("grade_ids")),
        "artifact_refs": e.select(named("f", "event_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "trial").when(F.col("user_id") % 5 == 0, "poem").otherwise("attempt").alias("entity_type"), F.coalesce(earlier, named("a", "event_id")).alias("entity_id")),
    }
