"""Candidate records, lists and scaling paths on small fixtures."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from candisieve.functions import vector_search
from candisieve.functions.topk import top_k_per_key
from candisieve.operators.retrieval import rrf, topk_with_fill
from candisieve.sources import candidates as sc
from candisieve.sources import results as sr

SIGNALS = {
    "profile_completeness_score": 95.0, "signup_date": "2020-05-01", "last_active_date": "2026-06-25",
    "open_to_work_flag": True, "profile_views_received_30d": 45, "applications_submitted_30d": 5,
    "recruiter_response_rate": 0.9, "avg_response_time_hours": 6.5, "skill_assessment_scores": {"Python": 95.0},
    "connection_count": 520, "endorsements_received": 42, "notice_period_days": 15,
    "expected_salary_range_inr_lpa": {"min": 25.0, "max": 35.0}, "preferred_work_mode": "remote",
    "willing_to_relocate": False, "github_activity_score": 78.5, "search_appearance_30d": 150,
    "saved_by_recruiters_30d": 8, "interview_completion_rate": 1.0, "offer_acceptance_rate": 0.85,
    "verified_email": True, "verified_phone": True, "linkedin_connected": True}
PROFILE = {
    "anonymized_name": " A  B ", "headline": "h", "summary": "s", "location": "Pune", "country": "India",
    "years_of_experience": 5.0, "current_title": "t", "current_company": "c", "current_company_size": "1", "current_industry": "i"}
GOOD = {"candidate_id": "CAND_0000001", "profile": PROFILE, "career_history": [], "education": [], "skills": [], "activity": SIGNALS}


def test_scan_and_quarantine(spark, tmp_path):
    lines = [json.dumps(GOOD), "", "invalid json string", json.dumps({"candidate_id": "CAND_0000003"}),
             json.dumps({**GOOD, "candidate_id": "BAD"})]
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(lines), encoding="utf-8")
    parsed = sc.read_candidates(spark, str(path), signals_key="activity")
    good, bad = sc.split_valid(parsed, {"required": ["candidate_id", "profile", "skills"]})
    assert [r.candidate_id for r in good.collect()] == ["CAND_0000001"]
    assert sorted(r.reject_reason for r in bad.collect()) == ["bad_json", "bad_value", "missing_key"]


def test_top_k_is_exact_under_a_hot_key(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 50 END AS k", "id", "id * 7919 % 1000 AS s")
    got = {(r.k, r.id) for r in top_k_per_key(df, ["k"], [F.desc("s"), F.asc("id")], 20, ["id"]).collect()}
    rows, want = df.collect(), set()
    for k in {r.k for r in rows}:
        want |= {(k, r.id) for r in sorted((r for r in rows if r.k == k), key=lambda r: (-r.s, r.id))[:20]}
    assert got == want


def test_vector_search_paths_agree(spark, monkeypatch):
    values = [[float((i * 37 + j * 11) % 17) for j in range(4)] for i in range(300)]
    items = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, values[i * 7]) for i in range(20)], "job_id long, embedding array<double>")
    def run():
        return {(r.job_id, r.vec_id, r["rank"]) for r in vector_search.vector_topk(items, queries, 5, "vec_id").collect()}
    small = run()
    monkeypatch.setattr(vector_search, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(vector_search, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(vector_search, "MOST_SCORES", 60)
    assert run() == small and len(small) == 100


def test_fill_and_fusion(spark):
    docs = spark.createDataFrame([(i,) for i in range(6)], "d long")
    jobs = spark.createDataFrame([(1,), (2,)], "job_id long")
    scores = spark.createDataFrame([(1, 3, 0.5), (1, 0, 0.9)], "job_id long, d long, score double")
    out = {(r.job_id, r["rank"]): r.d for r in topk_with_fill(scores, docs, jobs, "d", 4).collect()}
    assert [out[1, i] for i in range(1, 5)] == [0, 3, 1, 2] and [out[2, i] for i in range(1, 5)] == [0, 1, 2, 3]
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "job_id long, id string, rank long")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2)], "job_id long, id string, rank long")
    assert [r.id for r in rrf(a, b, "id", 2).orderBy("rank").collect()] == ["x", "y"]


def test_list_round_trip_and_cells(spark, tmp_path):
    rows = spark.createDataFrame([(1, "CAND_0000001", 1, 90.5, 'He said "go", twice'), (1, "CAND_0000002", 2, 80.0, "")],
                                 "job_id long, candidate_id string, rank long, final_score double, reasoning string")
    path = str(tmp_path / "list")
    sr.write_submission(rows, path)
    back = sr.read_submission(spark, path).orderBy("rank").collect()
    assert [(r["rank"], r.score, r.reasoning) for r in back] == [(1, 90.5, 'He said "go", twice'), (2, 80.0, "")]
    cells = sr.read_submission_cells(spark, path).collect()
    assert sorted((r.candidate_id, r.n_cells) for r in cells) == [("CAND_0000001", 4), ("CAND_0000002", 4)]


def test_streamed_files_get_the_same_verdicts(spark, tmp_path):
    from candisieve.streaming.ingest import ingest, stream_candidates
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text(json.dumps(GOOD) + "\nnot json\n", encoding="utf-8")
    query = ingest(stream_candidates(spark, str(source), "activity"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in got} == {"valid": 1, "quarantined": 1}


def test_duplicates_are_demoted_once(spark):
    from candisieve.operators.scoring import rank_cohort
    rows = spark.createDataFrame(
        [(1, f"c{i}", 90.0 - i, 1.0, "A" if i in (0, 2) else f"n{i}", 5.0, "T") for i in range(4)],
        "job_id long, candidate_id string, final_score double, behavior_score double, name string, "
        "years_of_experience double, current_title string")
    got = [(r.candidate_id, r.final_score) for r in rank_cohort(rows, 10).orderBy("rank").collect()]
    assert got == [("c0", 90.0), ("c1", 89.0), ("c3", 87.0), ("c2", 8.8)]


def test_ids_keep_all_digits(spark):
    from workloads.testbed import cid
    got = spark.sql(f"SELECT {cid('k')} AS c FROM VALUES (7), (10000000), (10000001) AS t(k)")
    assert [r.c for r in got.collect()] == ["CAND_0000007", "CAND_10000000", "CAND_10000001"]


def test_a_line_is_parsed_once_and_strictly(spark):
    def changed(**new):
        return json.dumps({**GOOD, **new})
    skill = {"name": "Go", "proficiency": "expert", "endorsements": 3}
    cases = {
        changed(): None, changed(unknown=[1]): None, changed(skills=[skill, {**skill, "duration_months": None}]): None,
        changed(certifications=None): None, changed(profile={**PROFILE, "years_of_experience": 5}): None,
        changed(profile={**PROFILE, "headline": 7}): None,
        changed(profile={**PROFILE, "years_of_experience": "5"}): "bad_value", changed(certifications="none"): "bad_value",
        changed(skills=[{**skill, "endorsements": 3.0}]): "bad_value", changed(skills=[{**skill, "duration_months": "x"}]): "bad_value",
        changed(skills=[{**skill, "endorsements": 2**40}]): "bad_value", changed(skills=[skill, None]): "bad_value",
        changed(activity={**SIGNALS, "verified_email": 1}): "bad_value", changed(activity={**SIGNALS, "skill_assessment_scores": {"Go": "9"}}): "bad_value",
        changed(profile=[PROFILE]): "missing_key", changed(profile=None): "missing_key", "[]": "missing_key", "5": "missing_key", "null": "missing_key",
        '{"a": 1': "bad_json", '{"a": 1, "a": 2}': "bad_json"}
    lines = spark.createDataFrame([(x,) for x in [*cases, " ", None]], "value string")
    parsed = sc.parse_candidates(lines, "activity")
    marked = sc.with_reject_reason(parsed, {"required": ["profile"], "properties": {"profile": {"required": ["headline"]}}})
    assert {r.value: r.reject_reason for r in marked.collect()} == cases
    good, _ = sc.split_valid(parsed)
    for df in (good, sc.validate_ranges(parsed).filter("ranges_ok"), sc.quarantine_counts(parsed, {"required": ["profile"]})):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("parseJson") == 1 and "from_json" not in plan and "get_json_object" not in plan


def test_checks_of_a_line_stand_once_in_the_plan(spark):
    """Neither the check of a root key nor a walk over the whole text is paid twice for a line."""
    lines = spark.range(1).select(F.lit("{}").alias("value")).union(spark.createDataFrame([(" \u3000\t",), (None,)], "value string"))
    parsed = sc.parse_candidates(lines)
    plan = parsed._jdf.queryExecution().optimizedPlan()
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        text = plan.toString()
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")
        spark.conf.unset("spark.sql.debug.maxToStringFields")

    def leaves(kind):
        if isinstance(kind, T.StructType):
            return sum(leaves(f.dataType) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return leaves(kind.elementType)
        return leaves(kind.valueType) if isinstance(kind, T.MapType) else int(not isinstance(kind, T.StringType))
    assert text.count("schemaOfVariant") == leaves(sc.CANDIDATE_SCHEMA) and "regexp_replace" not in text
    assert [r["value"] for r in parsed.collect()] == ["{}"]


def test_values_that_do_not_fit_at_every_level(spark):
    def fits(key, value):
        return sc.parse_candidates(spark.createDataFrame([('{"%s": %s}' % (key, value),)], "value string")).first()._corrupt is None
    for key, value in [("skills", '[{"endorsements": 5}, null, {"endorsements": null}, {}]'), ("skills", "null"), ("skills", "[]"), ("languages", '[{"language": 5}]'),
                       ("signals", '{"skill_assessment_scores": {"a": 1, "b": 1.5, "c": 1e300, "d": null}, "verified_email": true}'), ("signals", "{}"),
                       ("signals", '{"expected_salary_range_inr_lpa": {"min": 1, "other": "x"}}'), ("profile", '{"years_of_experience": 123456789012345678901}')]:
        assert fits(key, value), (key, value)
    for key, value in [("skills", '[{"endorsements": 5}, 7]'), ("skills", '[{"endorsements": 5.0}]'), ("skills", '[{"endorsements": 3000000000}]'), ("skills", "{}"),
                       ("languages", '["x"]'), ("languages", "[[]]"), ("signals", "[]"), ("signals", '{"skill_assessment_scores": {"a": "1"}}'), ("signals", '{"verified_email": 1}'),
                       ("signals", '{"expected_salary_range_inr_lpa": {"min": true}}'), ("signals", '{"expected_salary_range_inr_lpa": 3}'), ("profile", '{"years_of_experience": "7"}')]:
        assert not fits(key, value), (key, value)
