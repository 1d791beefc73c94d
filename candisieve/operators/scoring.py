"""Scoring: six factors, modifier, final score and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candisieve.functions.fixed_values import (
    AS_OF_DATE, DEGREES_DOCTOR, DEGREES_MASTER, EVIDENCE_METRICS, EVIDENCE_TECH, EVIDENCE_VERBS,
    FIELDS_BEST, FIELDS_GOOD, LEADERSHIP_WORDS, NOTABLE_EMPLOYERS, SCALE_WORDS,
)
from candisieve.functions.text import (
    any_of, bounded_in, clamp, constant, contains_any, let, lower_strip, mark_bounds, mark_literal, strip,
    try_date,
)
from candisieve.functions.topk import join_shares, key_shares, top_k_per_key, with_share
from candisieve.functions.vectors import as_vector, dot, l2_normalize, max_similarity
from candisieve.operators.anomaly import DUPLICATE_FACTOR, rank_order, same_person, with_confidence
from candisieve.operators.profile import build_profile
from candisieve.operators.skills import (
    attach_rarity, classify, prepare_candidates, prepare_jobs, skill_matches, skill_rarity,
)

YEARS = "years_of_experience"
BREAKDOWN = [
    "skill_score", "experience_score", "education_score", "project_score", "behavior_score",
    "availability_score"]
TIERS = ["critical_skills_matched", "important_skills_matched", "nice_to_have_skills_matched",
         "missing_critical_skills"]


# ------------------------------------------------------------------ skills (40)

def _recent_job() -> Column:
    job = F.get("career_history", F.lit(0))
    return F.concat_ws("\n", F.lower(job["description"]), F.lower(job["title"]))


def contribution(c: Column, recent: Column, rarity: Column) -> Column:
    """Points of one classified requirement.

    Met: 10 x weight x proficiency x duration x recent use x rarity. Supported: 5 x weight
    x rarity. A critical requirement that is not met costs 3 x rarity.
    """
    skill = c["skill"]
    known = skill.isNotNull() & ~F.coalesce(skill["is_cert"], F.lit(False))
    level = F.lower(skill["proficiency"])
    proficiency = (
        F.when(~known, 1.0).when(level.contains("expert"), 1.2).when(level.rlike("advanced|lead"), 1.1)
        .when(level.contains("intermediate"), 1.0).otherwise(0.7))
    months = F.coalesce(skill["months"], F.lit(0))
    duration = (
        F.when(~known, 1.0).when(months >= 36, 1.0).when(months >= 12, 0.9).when(months > 0, 0.8).otherwise(0.7))
    name = F.lower(F.coalesce(skill["name"], F.lit("")))
    used = F.contains(recent, F.lower(c["requirement"])) | ((name != "") & F.contains(recent, name))
    recency = F.when(F.coalesce(used, F.lit(False)), 1.2).otherwise(1.0)
    met = proficiency * duration * recency * 10.0 * c["weight"] * rarity
    return (
        F.when(c["cls"].isin("DIRECT", "EQUIVALENT"), met)
        .when(c["cls"] == "SUPPORTED", 5.0 * c["weight"] * rarity)
        .when(c["is_critical"], -3.0 * rarity).otherwise(0.0))


def with_contributions(classified: DataFrame) -> DataFrame:
    """Add ``points`` to every entry of ``classified``. Needs ``rarity``."""
    def scored(c: Column, recent: Column) -> Column:
        rarity = F.coalesce(F.try_element_at("rarity", c["norm"]), F.lit(1.0))
        return c.withField("points", contribution(c, recent, rarity))
    return classified.withColumn("classified", let(
        _recent_job(), lambda recent: F.transform("classified", lambda c: scored(c, recent))))


def skill_score() -> Column:
    """40 x points / most possible points; minus 20 when two critical skills exist
    and none is proven; between 0 and 40."""
    total = F.aggregate("classified", F.lit(0.0), lambda acc, c: acc + c["points"])
    possible = F.aggregate("classified", F.lit(0.0), lambda acc, c: acc + 10.0 * c["weight"])
    proven = F.exists("classified", lambda c: F.size(c["proves"]) > 0)
    penalty = F.when((F.size("critical") >= 2) & ~proven, 20.0).otherwise(0.0)
    base = F.when(possible > 0, 40.0 * (total / possible)).otherwise(0.0)
    return clamp(base - penalty, 0.0, 40.0)


def tier_lists() -> dict[str, Column]:
    """Requirement texts by tier, in requirement order."""
    def pick(test) -> Column:
        return F.transform(F.filter("classified", test), lambda c: c["requirement"])
    met = lambda c: c["cls"].isin("DIRECT", "EQUIVALENT")
    shown = lambda c: c["cls"].isin("DIRECT", "EQUIVALENT", "SUPPORTED")
    return {
        "critical_skills_matched": pick(lambda c: c["is_critical"] & met(c)),
        "important_skills_matched": pick(lambda c: ~c["is_critical"] & (c["weight"] >= 0.8) & shown(c)),
        "nice_to_have_skills_matched": pick(lambda c: ~c["is_critical"] & (c["weight"] < 0.8) & shown(c)),
        "missing_critical_skills": pick(lambda c: c["is_critical"] & ~met(c)),
    }


# ------------------------------------------------------------------ experience (25)

def job_titles_text() -> Column:
    return F.lower(F.array_join(F.transform("career_history", lambda j: j["title"]), "\n"))


def job_descriptions_text() -> Column:
    return F.lower(F.array_join(F.transform("career_history", lambda j: j["description"]), " "))


def count_words(text: Column, words: list[str]) -> Column:
    """How many of the constant words occur as substrings."""
    return let(text, lambda t: F.size(F.filter(constant(words), lambda w: F.contains(t, w))))


def experience_score(min_years: Column, similarity: Column, role_similarity: Column) -> Column:
    """K05. A missing similarity counts 0.5; no roles count 0."""
    tenure = F.when(min_years.isNotNull() & (F.col(YEARS) < min_years),
                    F.greatest(F.lit(0.0), 8.0 * (F.col(YEARS) / min_years))).otherwise(8.0)
    fit = clamp(7.0 * (F.coalesce(similarity, F.lit(0.5)) - 0.2) / 0.7, 0.0, 7.0)
    companies = F.array_join(F.transform("career_history", lambda j: j["company"]), "\n")
    employer = F.when(contains_any(F.lower(companies), NOTABLE_EMPLOYERS), 0.75).otherwise(0.0)
    lead = F.when(contains_any(job_titles_text(), LEADERSHIP_WORDS), 2.0).otherwise(0.0)
    scale = F.least(F.lit(5.0), count_words(job_descriptions_text(), SCALE_WORDS).cast("double"))
    role = clamp(3.0 * F.coalesce(role_similarity, F.lit(0.0)), 0.0, 3.0)
    return clamp(tenure + fit + employer + (lead + scale) + role, 0.0, 25.0)


# ------------------------------------------------------------------ education (10)

def education_score() -> Column:
    """K06. A field of study holding "ai" anywhere counts as relevant."""
    def field_in(words: list[str]) -> Column:
        return F.exists("education", lambda e: contains_any(F.lower(e["field_of_study"]), words))

    def degree_in(words: list[str]) -> Column:
        return F.exists("education", lambda e: contains_any(F.lower(e["degree"]), words))
    relevance = F.when(field_in(FIELDS_BEST), 8.0).when(field_in(FIELDS_GOOD), 6.0).otherwise(4.0)
    degree = F.when(degree_in(DEGREES_DOCTOR), 2.0).when(degree_in(DEGREES_MASTER), 1.0).otherwise(0.0)
    return F.least(F.lit(10.0), relevance + degree)


# ------------------------------------------------------------------ evidence (10)

def evidence_text() -> Column:
    descriptions = F.transform("career_history", lambda j: j["description"])
    titles = F.transform("career_history", lambda j: j["title"])
    return F.concat_ws(" ", "summary", "headline", F.array_join(descriptions, " "), F.array_join(titles, " "))


def evidence_snippets(requirements: Column, preferred: Column) -> Column:
    """Sentences that pair a verb of doing with a technology, in text order.

    Sentences of more than 10 characters, each wording once. A requirement or preferred
    line counts as a technology word. With a number, a percentage or a metric word the
    sentence is strong, else medium.
    """
    tech = F.array_sort(F.array_distinct(F.concat(
        F.transform(F.concat(requirements, preferred), lower_strip), constant(EVIDENCE_TECH))))
    finds = F.transform(tech, lambda t: F.struct(
        t.alias("tech"), F.contains(t, F.lit(" ")).alias("plain"), mark_literal(t).alias("find")))
    verb_pattern = r"(?U)\b(" + any_of(EVIDENCE_VERBS) + r")\b"
    metric_pattern = r"(?U)\b(" + any_of(EVIDENCE_METRICS) + r")\b"

    sentences = F.filter(F.transform(F.split(evidence_text(), r"[.\n\r;]+"), strip), lambda s: F.length(s) > 10)
    numbered = F.transform(sentences, lambda s, i: F.struct(
        s.alias("s"), F.lower(s).alias("low"), i.alias("pos")))
    with_verb = F.transform(
        F.filter(numbered, lambda x: x["low"].rlike(verb_pattern)), lambda x: F.struct(
            x["s"].alias("s"), x["low"].alias("low"), x["pos"].alias("pos"), mark_bounds(x["low"]).alias("mark")))

    def result(x: Column, finds: Column) -> Column:
        named = F.filter(finds, lambda t: F.when(t["plain"], F.contains(x["low"], t["tech"])).otherwise(
            bounded_in(t["find"], x["mark"])))
        strong = x["low"].rlike(r"(?U)\b\d") | F.contains(x["low"], F.lit("%")) | x["low"].rlike(metric_pattern)
        return F.struct(
            x["s"].alias("sentence"), F.when(strong, "strong").otherwise("medium").alias("quality"),
            F.regexp_extract(x["low"], verb_pattern, 1).alias("verb"),
            F.get(named, F.lit(0))["tech"].alias("tech"),
            F.when(strong, "numerical/metric").otherwise("none").alias("impact"))

    def first_wordings(found: Column) -> Column:
        lows = F.transform(found, lambda x: F.lower(x["sentence"]))
        return let(lows, lambda seen: F.filter(found, lambda x, i: F.array_position(
            seen, F.lower(x["sentence"])) == i + 1))
    hits = let(finds, lambda f: F.filter(F.transform(with_verb, lambda x: result(x, f)), lambda r: r["tech"].isNotNull()))
    return let(hits, first_wordings)


def evidence_density(snippets: Column) -> Column:
    """5 per strong and 2 per medium sentence, at most 25."""
    total = F.aggregate(snippets, F.lit(0.0), lambda acc, x: acc + F.when(x["quality"] == "strong", 5.0).otherwise(2.0))
    return F.least(F.lit(25.0), total)


def project_score(density: Column) -> Column:
    """K09."""
    return F.least(F.lit(10.0), density)


# ------------------------------------------------------------------ behaviour, availability, modifier

def behavior_score() -> Column:
    """K10."""
    s = F.col("signals")
    social = F.least(F.lit(2.0), s["connection_count"] / 1000.0 + s["endorsements_received"] / 100.0)
    verified = sum((F.when(s[f], 1).otherwise(0) for f in ["verified_email", "verified_phone", "linkedin_connected"]),
                   F.lit(0))
    return clamp(
        2.0 * (s["profile_completeness_score"] / 100.0) + 2.0 * s["recruiter_response_rate"]
        + 2.0 * s["interview_completion_rate"] + social + 2.0 * (verified / 3.0), 0.0, 10.0)


def availability_score() -> Column:
    """K11."""
    days, is_open = F.col("signals.notice_period_days"), F.col("signals.open_to_work_flag")
    points = (F.when((days == 0) | is_open, 4.0).when(days <= 15, 3.5).when(days <= 30, 3.0)
              .when(days <= 60, 2.0).when(days <= 90, 1.0).otherwise(0.5))
    return F.least(F.lit(5.0), points + F.when(is_open, 1.0).otherwise(0.0))


def modifier(as_of_year: int = int(AS_OF_DATE[:4])) -> Column:
    """Small factor for signal quality, inactivity, openness and long notice."""
    s = F.col("signals")
    complete, response = s["profile_completeness_score"], s["recruiter_response_rate"]
    quality = F.when((complete > 85) & (response > 0.8), 0.03).when((complete < 50) | (response < 0.4), -0.05).otherwise(0.0)
    inactive = F.when(F.year(try_date(s["last_active_date"])) < as_of_year, -0.03).otherwise(0.0)
    return (quality + inactive + F.when(s["open_to_work_flag"], 0.02).otherwise(0.0)
            + F.when(s["notice_period_days"] >= 90, -0.01).otherwise(0.0))


# ------------------------------------------------------------------ whole score

def final_score(base: Column, factor: Column) -> Column:
    """K13."""
    return F.round(clamp(base * (1.0 + factor), 0.0, 100.0), 4)


def score_cohort(
    cohort: DataFrame, jobs: DataFrame, cand: DataFrame, vectors: DataFrame | None = None,
    job_vectors: DataFrame | None = None, synonyms: DataFrame | None = None, as_of: str = AS_OF_DATE,
    rarity: DataFrame | None = None,
) -> DataFrame:
    """Score every row ``job_id, candidate_id`` of ``cohort``.

    ``vectors`` may hold ``candidate_id, embedding, role_embeddings`` and ``job_vectors``
    ``job_id, job_embedding, title_embedding``. Shuffles: the join of the ids with their job, which
    meets them in shares where they are many, the join of both with the candidates, whose wide rows
    are shuffled by their id only, and small aggregates for cohort rarity and the rows of a job.
    Everything else is a projection. Flagged rows stay, with score 0.
    """
    ready = prepare_candidates(with_confidence(build_profile(cand), as_of))
    if vectors is not None:
        ready = ready.join(vectors, "candidate_id", "left")
    else:
        ready = ready.withColumn("embedding", F.lit(None).cast("array<double>")).withColumn(
            "role_embeddings", F.lit(None).cast("array<array<double>>"))
    pairs = cohort.select("job_id", "candidate_id")
    shares = key_shares(pairs, "job_id")
    if rarity is None:
        rarity = skill_rarity(cohort.select("job_id", "candidate_id").join(
            cand.select("candidate_id", "skills"), "candidate_id"))
    job = attach_rarity(prepare_jobs(jobs), rarity)
    if job_vectors is not None:
        job = job.join(job_vectors, "job_id", "left")
    else:
        job = job.withColumn("job_embedding", F.lit(None).cast("array<double>")).withColumn(
            "title_embedding", F.lit(None).cast("array<double>"))
    # Candidate columns that share a name with the job's keep the candidate's meaning.
    job = job.select(
        "job_id", F.col("title").alias("job_title"), "requirements", "preferred_skills", "min_years",
        "critical", "atomic", "units", "rarity", "job_embedding", "title_embedding")
    rows = join_shares(with_share(pairs, shares, "job_id", "candidate_id"), job, shares, "job_id")
    return score_rows(rows.join(ready, "candidate_id"), synonyms, as_of)


def score_rows(rows: DataFrame, synonyms: DataFrame | None = None, as_of: str = AS_OF_DATE) -> DataFrame:
    """K01-K13 on prepared rows (one job, one candidate): a projection without shuffle."""
    # A flagged row scores 0 whatever its skills: it enters the ladder without requirements.
    rows = rows.withColumn("units", F.when(F.col("is_honeypot"), F.slice("units", 1, 0)).otherwise(F.col("units")))
    df = with_contributions(classify(skill_matches(rows, synonyms)))
    unit = lambda c: l2_normalize(as_vector(c))
    similarity = dot(unit("embedding"), unit("job_embedding"))
    roles = F.transform("role_embeddings", lambda v: l2_normalize(as_vector(v)))
    role_similarity = let(unit("title_embedding"), lambda q: max_similarity(roles, q))
    empty = F.expr("cast(array() as array<string>)")
    df = df.withColumn("evidence_snippets", evidence_snippets(
        F.coalesce("requirements", empty), F.coalesce("preferred_skills", empty)))
    parts = {
        "skill_score": skill_score(),
        "experience_score": experience_score(F.col("min_years"), similarity, role_similarity),
        "education_score": education_score(),
        "project_score": project_score(evidence_density(F.col("evidence_snippets"))),
        "behavior_score": behavior_score(),
        "availability_score": availability_score(),
    }
    df = df.withColumns({**parts, **tier_lists(), "_modifier": modifier(int(as_of[:4]))})
    df = df.withColumn("_base", sum((F.col(p) for p in BREAKDOWN[1:]), F.col(BREAKDOWN[0])))
    df = df.withColumn("final_score", final_score(F.col("_base"), F.col("_modifier")))
    flagged = F.col("is_honeypot")
    none = lambda c: F.when(flagged, F.lit(None)).otherwise(F.col(c))
    zero = lambda c: F.when(flagged, 0.0).otherwise(c)
    df = df.withColumn("engagement_bonus", zero(F.round(F.col("final_score") - F.col("_base"), 4)))
    df = df.withColumns({
        "final_score": zero(F.col("final_score")),
        **{p: zero(F.round(F.col(p), 4)) for p in BREAKDOWN},
        **{t: F.when(flagged, empty).otherwise(F.col(t)) for t in TIERS},
        "skill_analysis": none("skill_analysis"),
        "evidence_snippets": none("evidence_snippets"),
    })
    return df.select(
        "job_id", "candidate_id", "name", "headline", "summary", "current_title", "current_company", YEARS,
        "location", "open_to_work", "notice_period_days",
        F.transform("skills", lambda s: s["name"]).alias("skills"), "signals", "career_history", "education",
        "certifications", "job_title", "requirements", "preferred_skills", "is_honeypot", *BREAKDOWN,
        "engagement_bonus", "final_score", *TIERS, "skill_analysis", "evidence_snippets", "confidence_score",
        "confidence_penalties", "classified")


def rank_top(scored: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` rows per job with their rank."""
    return top_k_per_key(scored, ["job_id"], rank_order(), n, ["candidate_id"])


def rank_cohort(scored: DataFrame, n: int = 100, top: int = 100) -> DataFrame:
    """A14 then K14: duplicates demoted, then the first ``n`` rows.

    Demotion moves at most ``top`` rows of a job down, so its first ``n + top`` rows hold all
    that can be among the first ``n`` afterwards: they are cut once and marked where they are.
    """
    cut = top_k_per_key(scored, ["job_id"], rank_order(), n + top, ["candidate_id"], rank_col="_rank")
    marked = cut.withColumn("is_duplicate", (F.col("_rank") <= top) & (F.row_number().over(same_person()) > 1))
    demoted = F.when(F.col("is_duplicate"), F.round(F.col("final_score") * DUPLICATE_FACTOR, 4)).otherwise(F.col("final_score"))
    return rank_top(marked.withColumn("final_score", demoted).drop("_rank"), n)


def score_one(cand: DataFrame, jobs: DataFrame, candidate_id: str, job_id, **vectors) -> DataFrame:
    """One candidate against one job, without cohort rarity."""
    one = cand.filter(F.col("candidate_id") == candidate_id)
    job = jobs.filter(F.col("job_id") == job_id)
    cohort = one.select("candidate_id").withColumn("job_id", F.lit(job_id).cast(jobs.schema["job_id"].dataType))
    return score_pairs(cohort, one, job, **vectors)


def score_pairs(pairs: DataFrame, cand: DataFrame, jobs: DataFrame, **vectors) -> DataFrame:
    """K15 for a table of pairs: each scored on its own, rarity 1 throughout."""
    spark = pairs.sparkSession
    no_rarity = spark.createDataFrame([], jobs.select("job_id").schema.add("skill", "string").add("rarity", "double"))
    return score_cohort(pairs, jobs, cand, rarity=no_rarity, **vectors)


def honeypot_counts(ranked: DataFrame) -> DataFrame:
    """Flagged and clear rows per job."""
    return ranked.groupBy("job_id").agg(
        F.count_if("is_honeypot").alias("honeypots"), F.count_if(~F.col("is_honeypot")).alias("clear"))

