"""Skill evidence on small fixtures."""

from pyspark.sql import functions as F

from candisieve.operators import skills as sk
from candisieve.sources.synonyms import parse_synonyms

CASES = [
    # requirement, skills, career text, certifications, accepted classes
    ("Salesforce CRM/PRM Modules", ["Salesforce CRM"], "", [], {"EQUIVALENT"}),
    ("Salesforce CRM/PRM Modules", ["Salesforce"], "", [], {"NONE", "RELATED"}),
    ("Salesforce Service Cloud Sales Cloud", ["Salesforce", "Service Cloud"], "", [], {"EQUIVALENT"}),
    ("Salesforce Service Cloud Sales Cloud", ["Oracle CRM", "React"], "", [], {"NONE", "RELATED"}),
    ("Lightning Aura, LWC, HTML, CSS, JavaScript", ["JavaScript", "HTML", "CSS"], "", [], {"NONE", "RELATED", "SUPPORTED"}),
    ("elasticsearch", ["bm25"], "working on search engines", [], {"RELATED"}),
    ("elasticsearch", ["bm25"], "maintained elasticsearch clusters for search", [], {"SUPPORTED"}),
    ("Salesforce Platform Developer I", ["Salesforce", "Apex"], "", [], {"NONE"}),
    ("PD1", [], "", ["Salesforce Platform Developer I"], {"DIRECT"}),
    ("Salesforce Platform Developer I", [], "", ["PD1"], {"DIRECT"}),
    ("Salesforce", [], "", ["Salesforce Platform Developer I"], {"NONE"}),
]
PROFILE = ("candidate_id string, skills array<struct<name:string,proficiency:string,endorsements:int,duration_months:int>>, "
           "career_text string, certifications array<struct<name:string,issuer:string,year:int>>, current_title string, "
           "career_history array<struct<company:string,title:string,description:string>>")
REQUIREMENTS = [
    "Built retrieval over harbour texts with embeddings (Sentence-Transformers, BGE, E5, or the like)",
    "Kept a vector database in shape -- Qdrant, Milvus, Weaviate, Pinecone, or FAISS",
    "Tuned open models by LoRA or PEFT",
    "Measured search relevance -- MRR, NDCG, MAP",
]


def _profiles(spark, rows):
    return spark.createDataFrame([
        (cid, [(s, "Expert", 1, 24) for s in skills], text, [(c, "x", 2020) for c in certs], "", [])
        for cid, skills, text, certs in rows], PROFILE)


def test_ladder_cases(spark):
    cand = sk.prepare_candidates(_profiles(spark, [(f"c{i}", c[1], c[2], c[3]) for i, c in enumerate(CASES)]))
    units = spark.createDataFrame([(f"c{i}", c[0]) for i, c in enumerate(CASES)], "candidate_id string, requirement string")
    rows = cand.join(units, "candidate_id").select("candidate_id", sk.ladder(sk.requirement_unit(F.col("requirement"))).alias("hit"))
    found = {r.candidate_id: r.hit for r in rows.collect()}
    for i, case in enumerate(CASES):
        assert found[f"c{i}"].cls in case[4], (case, found[f"c{i}"])
    assert round(found["c0"].measure * 100) == 67
    assert round(found["c2"].measure * 100) == 75


def test_critical_skills_do_not_depend_on_line_order(spark):
    jobs = spark.createDataFrame([
        (1, REQUIREMENTS, ["XGBoost"], ["FAISS"]), (2, REQUIREMENTS[::-1], ["XGBoost"], ["FAISS"])],
        "job_id long, requirements array<string>, preferred_skills array<string>, technical_skills array<string>")
    found = {r.job_id: r.critical for r in sk.prepare_jobs(jobs).select("job_id", "critical").collect()}
    assert found[1] == found[2] and len(found[1]) == 2 and "xgboost" not in found[1]


def test_lower_case_homographs_are_no_technology(spark):
    lines = spark.createDataFrame([("we go fast and react to the rest",), ("Go and React",), ("modern C++ code",)], "line string")
    found = [r.t for r in lines.select(sk.ontology_terms_in_text(F.col("line")).alias("t")).collect()]
    assert found == [[], ["go", "react"], ["c++"]]


def test_skill_analysis(spark):
    synonyms = parse_synonyms(spark.createDataFrame([(
        '{"sentence transformers": "sentence-transformers", "retrieval augmented generation": "RAG", "n": 1}',)], "value string"))
    assert {r.synonym: r.canonical for r in synonyms.collect()} == {
        "sentence transformers": "sentence transformers", "retrieval augmented generation": "rag"}
    pair = spark.createDataFrame(
        [(1, "c", ["python", "sentence-transformers", "Kubernetes", "We want good code"], ["fastapi", "PyTorch"],
          [("Python",), ("Sentence Transformers",), ("Flask",), ("FastAPI",), ("Go",)], None)],
        "job_id long, candidate_id string, requirements array<string>, preferred_skills array<string>, "
        "skills array<struct<name:string>>, certifications array<struct<name:string,issuer:string,year:int>>")
    a = sk.skill_matches(pair, synonyms).head().skill_analysis
    assert a.exact_matches == ["fastapi", "python", "sentence transformers"] and a.synonym_matches == []
    assert a.missing_required_skills == ["kubernetes", "we want good code"]
    assert a.missing_preferred_skills == ["pytorch"] and a.additional_candidate_skills == ["flask", "go"]
