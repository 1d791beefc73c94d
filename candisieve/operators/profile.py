"""Profile projections: the derived text fields of a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candisieve.functions.text import (
    norm_list, norm_raw, norm_text, strip, term_tokens,
)


def _p(field: str) -> Column:
    return F.col(f"profile.{field}")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _join(array: Column) -> Column:
    return F.array_join(array, " ")


def _parts(*columns: Column) -> Column:
    """Non-empty parts joined by one space."""
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in columns])


def _jobs() -> Column:
    return F.col("career_history")


def location_expr() -> Column:
    """P04."""
    return norm_raw(F.concat_ws(
        ", ", F.nullif(_p("location"), F.lit("")), F.nullif(_p("country"), F.lit(""))))


def normalized_skills() -> Column:
    """P05."""
    return norm_list(F.transform("skills", lambda s: s["name"]))


def normalized_titles() -> Column:
    """P05."""
    return norm_list(F.transform(_jobs(), lambda j: j["title"]))


def work_history_text() -> Column:
    """P06."""
    return norm_text(_join(F.transform(
        _jobs(), lambda j: F.concat_ws(" ", _text(j["title"]), _text(j["company"]), _text(j["description"])))))


def skills_text() -> Column:
    """P07."""
    return _join(normalized_skills())


def profile_text() -> Column:
    """P08. The parts are normalised, so joining the non-empty ones leaves nothing to clean."""
    return F.lower(_parts(*[
        norm_raw(_p(f)) for f in
        ["anonymized_name", "headline", "summary", "current_title", "current_company"]]))


def career_text() -> Column:
    """P09."""
    return _parts(profile_text(), work_history_text())


def education_text() -> Column:
    """P10."""
    return norm_text(_join(F.transform("education", lambda e: F.concat_ws(
        " ", _text(e["institution"]), _text(e["degree"]), _text(e["field_of_study"]), _text(e["tier"])))))


def sparse_text() -> Column:
    """Text of the lexical index."""
    def fields(array: str, *names: str) -> Column:
        return _join(F.flatten(F.transform(array, lambda x: F.array(
            *[_text(x[n]) for n in names]))))
    return norm_text(F.concat_ws(
        " ", *[_text(_p(f)) for f in ["headline", "summary", "current_title", "current_company"]],
        fields("skills", "name"), fields("career_history", "title", "company", "description"),
        fields("education", "degree", "field_of_study", "institution")))


def dense_text(max_skills: int = 25) -> Column:
    """Short text for embeddings, with the first ``max_skills`` skills."""
    return norm_text(F.concat_ws(
        " ", *[_text(_p(f)) for f in ["headline", "current_title", "current_company"]],
        _join(F.transform(F.slice("skills", 1, max_skills), lambda s: _text(s["name"])))))


def bm25_tokens() -> Column:
    """Tokens of title, headline, summary and skill names."""
    text = F.concat_ws(
        " ", norm_raw(_p("current_title")), norm_raw(_p("headline")), norm_raw(_p("summary")),
        _join(F.transform("skills", lambda s: s["name"])))
    return term_tokens(F.lower(text))


def query_text(title: str = "title", summary: str = "summary",
               requirements: str = "requirements", preferred: str = "preferred_skills") -> Column:
    """Query text of a posting; empty parts leave no gap."""
    return F.lower(strip(_parts(
        F.col(title), F.col(summary), _join(F.col(requirements)), _join(F.col(preferred)))))


def recent_roles() -> Column:
    """Current title, then the non-empty titles of the first two jobs."""
    titles = F.filter(F.transform(F.slice(_jobs(), 1, 2), lambda j: j["title"]),
                      lambda t: t.isNotNull() & (t != ""))
    return F.concat(F.array(norm_raw(_p("current_title"))), titles)


def build_profile(cand: DataFrame) -> DataFrame:
    """Candidate with normalised and derived fields.

    A projection only: the derived strings are computed where they are read, and
    unused ones are pruned away.
    """
    return cand.select(
        "candidate_id",
        norm_raw(_p("anonymized_name")).alias("name"),
        norm_raw(_p("headline")).alias("headline"),
        norm_raw(_p("summary")).alias("summary"),
        norm_raw(_p("current_title")).alias("current_title"),
        norm_raw(_p("current_company")).alias("current_company"),
        _p("years_of_experience").alias("years_of_experience"),
        "skills", "education", "certifications", "languages", "career_history", "signals",
        F.col("signals.notice_period_days").alias("notice_period_days"),
        F.col("signals.open_to_work_flag").alias("open_to_work"),
        location_expr().alias("location"),
        normalized_skills().alias("normalized_skills"),
        normalized_titles().alias("normalized_titles"),
        work_history_text().alias("work_history_text"),
        skills_text().alias("skills_text"),
        profile_text().alias("profile_text"),
        career_text().alias("career_text"),
        education_text().alias("education_text"),
    )


def dataset_stats(valid: DataFrame, malformed: DataFrame | None = None) -> DataFrame:
    """Totals, averages (2 decimals) and missing parts, in one pass over the data."""
    n_skills = F.size("skills")
    stats = valid.agg(
        F.count("*").alias("total_candidates"),
        F.coalesce(F.round(F.avg(n_skills), 2), F.lit(0.0)).alias("average_skills"),
        F.coalesce(F.round(F.avg(_p("years_of_experience")), 2), F.lit(0.0)).alias("average_experience"),
        F.count_if(strip(_text(_p("summary"))) == "").alias("missing_summaries"),
        F.count_if(n_skills == 0).alias("missing_skills"),
        F.count_if(F.size(_jobs()) == 0).alias("missing_work_history"),
    )
    bad = F.lit(0).cast("long") if malformed is None else malformed.agg(F.count("*")).scalar()
    return stats.withColumn("malformed_candidates", bad)
