"""Candidate records: scan, validate, quarantine, look up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candisieve.functions.fixed_values import ID_PATTERN
from candisieve.functions.text import let, not_blank

_STRING, _INT, _DOUBLE, _BOOL = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CANDIDATE_SCHEMA = _struct(
    candidate_id=_STRING,
    profile=_struct(
        anonymized_name=_STRING, headline=_STRING, summary=_STRING, location=_STRING, country=_STRING,
        years_of_experience=_DOUBLE, current_title=_STRING, current_company=_STRING,
        current_company_size=_STRING, current_industry=_STRING),
    career_history=T.ArrayType(_struct(
        company=_STRING, title=_STRING, start_date=_STRING, end_date=_STRING, duration_months=_INT,
        is_current=_BOOL, industry=_STRING, company_size=_STRING, description=_STRING)),
    education=T.ArrayType(_struct(
        institution=_STRING, degree=_STRING, field_of_study=_STRING, start_year=_INT, end_year=_INT,
        grade=_STRING, tier=_STRING)),
    skills=T.ArrayType(_struct(name=_STRING, proficiency=_STRING, endorsements=_INT, duration_months=_INT)),
    certifications=T.ArrayType(_struct(name=_STRING, issuer=_STRING, year=_INT)),
    languages=T.ArrayType(_struct(language=_STRING, proficiency=_STRING)),
    signals=_struct(
        profile_completeness_score=_DOUBLE, signup_date=_STRING, last_active_date=_STRING,
        open_to_work_flag=_BOOL, profile_views_received_30d=_INT, applications_submitted_30d=_INT,
        recruiter_response_rate=_DOUBLE, avg_response_time_hours=_DOUBLE,
        skill_assessment_scores=T.MapType(_STRING, _DOUBLE), connection_count=_INT,
        endorsements_received=_INT, notice_period_days=_INT,
        expected_salary_range_inr_lpa=_struct(min=_DOUBLE, max=_DOUBLE), preferred_work_mode=_STRING,
        willing_to_relocate=_BOOL, github_activity_score=_DOUBLE, search_appearance_30d=_INT,
        saved_by_recruiters_30d=_INT, interview_completion_rate=_DOUBLE, offer_acceptance_rate=_DOUBLE,
        verified_email=_BOOL, verified_phone=_BOOL, linkedin_connected=_BOOL),
)

CORRUPT, JSON = "_corrupt", "_json"
VERDICTS = ["good", "bad_json", "missing_key", "bad_value"]
# Ids that a lookup pushes into the scan at most; the session pushes lists up to that length.
MOST_LISTED = 256


def _fits(value: Column, kind: T.DataType) -> Column:
    """Whether a VARIANT holds what ``kind`` asks for; absent and null values do.

    Numbers and truth values must be written as such, and whole numbers without a decimal point; text
    takes any value.
    """
    if isinstance(kind, T.StringType):
        return F.lit(True)
    if isinstance(kind, T.StructType):
        # The fields are taken from the object in one go, and each is read by its place from then on.
        checked = [f for f in kind.fields if not isinstance(f.dataType, T.StringType)]
        taken = "struct<" + ",".join(f"{f.name}:variant" for f in checked or kind.fields[:1]) + ">"
        ok = let(F.try_variant_get(value, "$", taken), lambda held: reduce(
            Column.__and__, [_fits(held[f.name], f.dataType) for f in checked], held.isNotNull()))
    elif isinstance(kind, T.ArrayType):
        ok = F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: _fits(x, kind.elementType)), F.lit(False))
    elif isinstance(kind, T.MapType):
        inner = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
        ok = F.coalesce(F.forall(inner, lambda x: _fits(x, kind.valueType)), F.lit(False))
    else:
        written = {_INT: ["BIGINT"], _DOUBLE: ["BIGINT", "DOUBLE", "FLOAT", "DECIMAL"], _BOOL: ["BOOLEAN"]}[kind]
        ok = F.substring(F.schema_of_variant(value), 1, 7).isin(written)
        if kind == _INT:
            ok = ok & F.try_variant_get(value, "$", "int").isNotNull()
    return ok | value.isNull() | F.is_variant_null(value)


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns that later filters and projections read instead of computing them again."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def parse_candidates(lines: DataFrame, signals_key: str = "signals") -> DataFrame:
    """Parse one JSON object per line of ``value``, once, to the VARIANT ``_json``.

    Typed columns and all checks read that VARIANT. Blank lines vanish; a line that is not a JSON
    object of the schema keeps its text in ``_corrupt``, and a root key that does not fit is null.
    Types are strict: the text "5" is not the number 5. Unknown keys are ignored; an object that
    repeats a key is no JSON here (``_json`` is null). ``signals_key`` names the root key that holds
    the activity signals.
    """
    parsed = _once(lines.filter(not_blank("value")).select("value"), F.try_parse_json("value").alias(JSON))
    root = _once(parsed, F.try_variant_get(JSON, "$", "map<string,variant>").alias("_root"))
    fields = list(enumerate(CANDIDATE_SCHEMA.fields))
    held = _once(root, *[F.try_element_at("_root", F.lit(signals_key if f.name == "signals" else f.name)).alias(f"_held{i}") for i, f in fields])
    checked = _once(held, *[_fits(F.col(f"_held{i}"), f.dataType).alias(f"_fits{i}") for i, f in fields])
    columns = [F.when(F.col(f"_fits{i}"), F.try_variant_get(f"_held{i}", "$", f.dataType.simpleString())).alias(f.name) for i, f in fields]
    ok = reduce(Column.__and__, [F.col(f"_fits{i}") for i, _ in fields], F.col("_root").isNotNull())
    typed = _once(checked, *columns, F.when(~ok, F.col("value")).alias(CORRUPT))
    return typed.drop("_root", *[f"_{what}{i}" for i, _ in fields for what in ("held", "fits")])


def read_candidates(spark: SparkSession, path: str, signals_key: str = "signals") -> DataFrame:
    """Scan JSON lines. Rows that fail to parse carry their text in ``_corrupt``."""
    return parse_candidates(spark.read.text(path), signals_key)


def _has_keys(json: Column, keys: list[str]) -> Column:
    """Whether a VARIANT is an object with all ``keys``; a key holding null is present."""
    missing = F.array_except(F.array(*[F.lit(k) for k in keys]), F.map_keys(F.try_variant_get(json, "$", "map<string,variant>")))
    return F.coalesce(F.size(missing) == 0, F.lit(False))


def required_ok(schema: dict | None, json: Column) -> Column:
    """Row predicate of S02 on the VARIANT of a line."""
    if not schema:
        return F.lit(True)
    root = schema.get("required", [])
    inner = schema.get("properties", {}).get("profile", {}).get("required", [])
    ok = _has_keys(json, root) if root else F.lit(True)
    profile = F.try_variant_get(json, "$.profile", "variant")
    if inner:
        return F.coalesce(ok & _has_keys(profile, inner), F.lit(False))
    return ok & (profile.isNull() | F.is_variant_null(profile) | _has_keys(profile, []))


def validate_required(df: DataFrame, schema: dict | None, json_col: str = JSON) -> DataFrame:
    """Add ``required_ok``; without a schema every row passes."""
    return df.withColumn("required_ok", required_ok(schema, F.col(json_col)))


def _all_set(item: Column, fields: list[str]) -> Column:
    ok = F.lit(True)
    for field in fields:
        ok = ok & item[field].isNotNull()
    return ok


def _every(array: Column, test) -> Column:
    return F.forall(array, test)


def ranges_ok(id_pattern: str = ID_PATTERN) -> Column:
    """Row predicate of S03: id pattern, bounds and required fields of every level."""
    p, s = F.col("profile"), F.col("signals")
    names = [f.name for f in CANDIDATE_SCHEMA["profile"].dataType.fields]
    signal_names = [f.name for f in CANDIDATE_SCHEMA["signals"].dataType.fields]
    non_negative = [
        "profile_views_received_30d", "applications_submitted_30d", "avg_response_time_hours",
        "connection_count", "endorsements_received", "search_appearance_30d",
        "saved_by_recruiters_30d"]
    ok = F.col("candidate_id").rlike(id_pattern)
    ok = ok & p.isNotNull() & _all_set(p, names)
    ok = ok & p["years_of_experience"].between(0, 50)
    ok = ok & s.isNotNull() & _all_set(s, signal_names)
    ok = ok & s["profile_completeness_score"].between(0, 100)
    ok = ok & s["recruiter_response_rate"].between(0, 1)
    ok = ok & s["interview_completion_rate"].between(0, 1)
    ok = ok & s["notice_period_days"].between(0, 180)
    ok = ok & s["github_activity_score"].between(-1, 100)
    ok = ok & s["offer_acceptance_rate"].between(-1, 1)
    for name in non_negative:
        ok = ok & (s[name] >= 0)
    salary = s["expected_salary_range_inr_lpa"]
    ok = ok & (salary["min"] >= 0) & (salary["max"] >= 0)
    ok = ok & _every(F.map_values(s["skill_assessment_scores"]), lambda v: v.isNotNull())
    jobs, schools, skills = F.col("career_history"), F.col("education"), F.col("skills")
    ok = ok & jobs.isNotNull() & _every(jobs, lambda j: _all_set(
        j, ["company", "title", "start_date", "duration_months", "is_current", "industry",
            "company_size", "description"]) & (j["duration_months"] >= 0))
    ok = ok & schools.isNotNull() & _every(schools, lambda e: _all_set(
        e, ["institution", "degree", "field_of_study", "start_year", "end_year", "tier"])
        & e["start_year"].between(1970, 2030) & e["end_year"].between(1970, 2035))
    ok = ok & skills.isNotNull() & _every(skills, lambda k: _all_set(
        k, ["name", "proficiency", "endorsements"]) & (k["endorsements"] >= 0)
        & (F.coalesce(k["duration_months"], F.lit(0)) >= 0))
    certs, languages = F.col("certifications"), F.col("languages")
    ok = ok & (certs.isNull() | _every(certs, lambda c: _all_set(c, ["name", "issuer", "year"])))
    ok = ok & (languages.isNull()
               | _every(languages, lambda x: _all_set(x, ["language", "proficiency"])))
    return F.coalesce(ok, F.lit(False))


def validate_ranges(df: DataFrame, id_pattern: str = ID_PATTERN) -> DataFrame:
    """Add ``ranges_ok``."""
    return df.withColumn("ranges_ok", ranges_ok(id_pattern))


def reject_reason(required_schema: dict | None = None, id_pattern: str = ID_PATTERN) -> Column:
    """Why a parsed row is rejected; null for a valid row. First failing check wins."""
    return (
        F.when(F.col(JSON).isNull(), "bad_json")
        .when(~required_ok(required_schema, F.col(JSON)), "missing_key")
        .when(F.col(CORRUPT).isNotNull() | ~ranges_ok(id_pattern), "bad_value")
    )


def with_reject_reason(
    parsed: DataFrame, required_schema: dict | None = None, id_pattern: str = ID_PATTERN,
) -> DataFrame:
    return parsed.withColumn("reject_reason", reject_reason(required_schema, id_pattern))


def split_valid(
    parsed: DataFrame, required_schema: dict | None = None, id_pattern: str = ID_PATTERN,
) -> tuple[DataFrame, DataFrame]:
    """Valid candidates, and quarantined lines with their reason."""
    marked = with_reject_reason(parsed, required_schema, id_pattern)
    good = marked.filter("reject_reason IS NULL").select(*CANDIDATE_SCHEMA.fieldNames())
    bad = marked.filter("reject_reason IS NOT NULL").select("value", "reject_reason")
    return good, bad


def quarantine_counts(parsed: DataFrame, required_schema: dict | None = None) -> DataFrame:
    """Rejected lines per reason."""
    return (
        with_reject_reason(parsed, required_schema)
        .filter("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count("*").alias("n"))
    )


def ingest(
    lines: DataFrame, path: str, required_schema: dict | None = None, id_pattern: str = ID_PATTERN, signals_key: str = "signals",
) -> DataFrame:
    """Store valid candidates and quarantined lines, and count them, in one pass over the lines.

    ``{path}/verdict=good`` holds the candidates, ``verdict=bad_json``, ``missing_key`` and
    ``bad_value`` the rejected lines in ``value``. The counts, ``verdict, n``, are metrics of the write
    itself, so the lines are parsed once.
    """
    marked = with_reject_reason(parse_candidates(lines, signals_key), required_schema, id_pattern)
    verdict = F.coalesce("reject_reason", F.lit("good"))
    good = F.col("verdict") == "good"
    stored = marked.withColumn("verdict", verdict).select(
        "verdict", F.when(~good, F.col("value")).alias("value"), *[F.when(good, F.col(c)).alias(c) for c in CANDIDATE_SCHEMA.fieldNames()])
    seen = Observation("verdicts")
    counted = [F.count_if(F.col("verdict") == name).alias(name) for name in VERDICTS]
    stored.observe(seen, *counted).write.partitionBy("verdict").parquet(path)
    rows = [(name, int(seen.get[name])) for name in VERDICTS]
    return lines.sparkSession.createDataFrame(rows, "verdict string, n long")


def write_lookup_store(cand: DataFrame, path: str, row_group_bytes: int = 8 << 20) -> None:
    """Candidates in files by range of id, sorted, with a bloom filter of the ids in every row group.

    A lookup then reads the row groups whose range and filter may hold one of its ids, and of those
    the pages that the column index leaves.
    """
    (cand.repartitionByRange("candidate_id").sortWithinPartitions("candidate_id").write
     .option("parquet.bloom.filter.enabled#candidate_id", "true").option("parquet.block.size", str(row_group_bytes)).parquet(path))


def stored_lookup(spark: SparkSession, path: str, ids: DataFrame, most_listed: int = MOST_LISTED) -> DataFrame:
    """The stored candidates whose id is listed.

    Up to ``most_listed`` different ids are pushed into the scan; more are joined, where nearly every
    row group holds one anyhow. Both give the same rows. Null ids match nothing.
    """
    wanted = ids.select("candidate_id").where("candidate_id is not null").distinct()
    store = spark.read.parquet(path)
    listed = [r["candidate_id"] for r in wanted.limit(most_listed + 1).collect()]
    if len(listed) > most_listed:
        return lookup(store, wanted)
    return store.where(F.col("candidate_id").isin(listed)) if listed else store.where(F.lit(False))


def lookup(cand: DataFrame, ids: DataFrame) -> DataFrame:
    """The candidates whose id is listed. Ids may repeat; rows do not."""
    return cand.join(ids.select("candidate_id"), "candidate_id", "left_semi")


def preflight(lines: DataFrame) -> DataFrame:
    """Row count, rows with the two mandatory root keys, and the verdict.

    A file is refused when it is empty or when no row carries both keys. The first-five
    form of the check is ``preflight_head``.
    """
    shaped = _has_keys(F.try_parse_json("value"), ["candidate_id", "profile"])
    counts = lines.filter(not_blank("value")).agg(
        F.count("*").alias("n_rows"), F.count_if(shaped).alias("n_shaped"))
    return counts.withColumn("accepted", (F.col("n_rows") > 0) & (F.col("n_shaped") > 0))


def preflight_head(lines: DataFrame, n: int = 5) -> DataFrame:
    """S08 on the first ``n`` rows as they lie in the file."""
    return preflight(lines.filter(not_blank("value")).limit(n))


def dataset_status(df: DataFrame) -> DataFrame:
    """Rows, files and last change of a file-based table.

    ``df`` must come straight from a file scan, which provides ``_metadata``.
    """
    return df.select(F.col("_metadata.file_name").alias("f"),
                     F.col("_metadata.file_modification_time").alias("t")).agg(
        F.count("*").alias("candidate_count"), F.min("f").alias("file_name"),
        F.count_distinct("f").alias("n_files"), F.max("t").alias("last_updated"),
    ).withColumn("status", F.when(F.col("candidate_count") > 0, "loaded").otherwise("idle"))
