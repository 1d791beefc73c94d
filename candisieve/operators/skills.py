"""Skill evidence: matching candidate skills with requirements.

A pair of a job and a candidate is one row. The job side is prepared once per job
(``prepare_jobs``) and the candidate side once per candidate (``prepare_candidates``);
after their equi-join every rung is an expression over the two arrays of the row, so
matching needs no shuffle, no explosion into requirement-by-skill rows, and no regex
that depends on data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candisieve.functions.fixed_values import (
    BROAD_TERMS, CERT_ALIASES, CERT_SIGNAL, COMPETITOR_GROUPS, COMPOSITE_STOPWORDS,
    EQUIVALENT_DOMAINS, FAMILY_PATTERNS, GENERIC_SKILL_WORDS, ONTOLOGY, SIMILAR_SKILLS,
    SIMILARITY_SYNONYMS, SKILL_ALIASES, SUPPORTED_DOMAINS,
)
from candisieve.functions.text import (
    bounded_in, clean_skill, constant, in_words, let, list_lookup, lookup, lower_strip, mark_bounds,
    mark_literal, mark_word, no_strings, py_mark_literal, records, reverse_aliases, strip,
)

ALIAS_OF = reverse_aliases(SKILL_ALIASES)
CERT_OF = reverse_aliases(CERT_ALIASES)

_empty = no_strings


def _first(array: Column, keep: Callable, make: Callable) -> Column:
    """``make`` of the first element that passes ``keep``; null if none."""
    return F.get(F.transform(F.slice(F.filter(array, keep), 1, 1), make), F.lit(0))


# ------------------------------------------------------------------ skill analysis

def normalize_skill(c: Column, synonyms: Column | None = None) -> Column:
    """Cleaned name, replaced by its canonical name where ``synonyms`` has one."""
    cleaned = clean_skill(c)
    if synonyms is None:
        return cleaned
    return clean_skill(F.coalesce(F.try_element_at(synonyms, cleaned), cleaned))


def is_cert_text(c: Column) -> Column:
    return c.rlike("(?iU)" + CERT_SIGNAL)


def text_match(skill: Column, requirement: Column, is_cert: Column, requirement_mark: Column | None = None,
               skill_mark: Column | None = None) -> Column:
    """Is the skill named in the requirement?

    Certifications must be equal up to their aliases. A name of several words matches as
    a substring; a single word needs word boundaries at ends that are letters or digits.
    """
    mark = mark_bounds(requirement) if requirement_mark is None else requirement_mark
    word = mark_word(skill) if skill_mark is None else skill_mark
    plain = F.when(skill == "", F.lit(False)).when(
        F.contains(skill, F.lit(" ")), F.contains(requirement, skill)
    ).otherwise(F.contains(mark, word))
    return F.when(is_cert, lookup(skill, CERT_OF) == lookup(requirement, CERT_OF)).otherwise(plain)


def _norm_requirements(lines: Column, synonyms: Column | None) -> Column:
    norms = F.array_distinct(F.filter(
        F.transform(lines, lambda r: normalize_skill(r, synonyms)), lambda r: r != ""))
    return F.transform(F.array_sort(norms), lambda r: F.struct(
        r.alias("norm"), mark_bounds(r).alias("mark"), is_cert_text(r).alias("is_cert")))


def skill_matches(pairs: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Add ``skill_analysis`` to rows of one job and one candidate.

    Needs ``requirements, preferred_skills, skills, certifications``. Fields: the
    normalised lists, exact and synonym matches, missing required and preferred lines,
    additional candidate skills; all sorted.
    """
    from candisieve.sources.synonyms import synonym_map

    df = pairs if synonyms is None else pairs.withColumn("_syn", synonym_map(synonyms))
    syn = None if synonyms is None else F.col("_syn")

    def side(lines: Column) -> Column:
        return _norm_requirements(F.coalesce(lines, _empty()), syn)

    named = F.transform("skills", lambda s: F.struct(
        normalize_skill(s["name"], syn).alias("norm"), clean_skill(s["name"]).alias("clean")))
    marked = F.transform(F.array_distinct(F.filter(named, lambda s: s["norm"] != "")), lambda s: F.struct(
        s["norm"].alias("norm"), mark_word(s["norm"]).alias("mark"),
        s["clean"].alias("clean"), mark_word(s["clean"]).alias("clean_mark")))
    certs = F.array_distinct(F.filter(F.transform(
        F.coalesce("certifications", F.array().cast("array<struct<name:string,issuer:string,year:int>>")),
        lambda c: clean_skill(c["name"])), lambda c: c != ""))
    df = (df.withColumn("_req", side(F.col("requirements"))).withColumn("_pref", side(F.col("preferred_skills")))
          .withColumn("_skills", marked).withColumn("_certs", certs))
    no = F.lit(False)
    lines = F.concat("_req", "_pref")

    def skill_hit(s: Column, r: Column) -> Column:
        return ~r["is_cert"] & text_match(s["norm"], r["norm"], no, r["mark"], s["mark"])

    def exact_hit(s: Column, r: Column) -> Column:
        return skill_hit(s, r) & text_match(s["clean"], r["norm"], no, r["mark"], s["clean_mark"])

    def hits(lines: Column, test: Callable) -> Column:
        return F.array_distinct(F.transform(
            F.filter("_skills", lambda s: F.exists(lines, lambda r: test(s, r))), lambda s: s["norm"]))

    cert_hits = F.filter("_certs", lambda c: F.exists(
        lines, lambda r: r["is_cert"] & text_match(c, r["norm"], F.lit(True))))
    df = df.withColumn("_exact", F.array_union(hits(lines, exact_hit), cert_hits))

    # A name is a synonym match of a line when no spelling of it matches that line
    # exactly. Required lines may list it beside an exact match; preferred ones not.
    def synonym_only(lines: Column) -> Column:
        return F.array_distinct(F.transform(F.filter("_skills", lambda s: F.exists(
            lines, lambda r: skill_hit(s, r) & ~F.exists(
                F.filter("_skills", lambda o: o["norm"] == s["norm"]), lambda o: exact_hit(o, r)))),
            lambda s: s["norm"]))

    # A preferred line sees the exact matches of the lines before it; an exact match on a
    # later preferred line leaves the synonym in both lists.
    def earlier_exact(s: Column, r: Column) -> Column:
        before = F.filter("_pref", lambda p: p["pos"] < r["pos"])
        return F.exists(F.concat(F.transform("_req", _no_pos), F.transform(before, _no_pos)),
                        lambda q: F.exists(F.filter("_skills", lambda o: o["norm"] == s["norm"]),
                                           lambda o: exact_hit(o, q)))

    def _no_pos(r: Column) -> Column:
        return F.struct(r["norm"].alias("norm"), r["mark"].alias("mark"), r["is_cert"].alias("is_cert"))

    first_seen = F.array_distinct(F.filter(F.transform(
        F.coalesce("preferred_skills", _empty()), lambda r: normalize_skill(r, syn)), lambda r: r != ""))
    df = df.withColumn("_pref", let(first_seen, lambda seen: F.transform("_pref", lambda r: F.struct(
        r["norm"].alias("norm"), r["mark"].alias("mark"), r["is_cert"].alias("is_cert"),
        F.array_position(seen, r["norm"]).alias("pos")))))
    preferred_synonyms = F.array_distinct(F.transform(F.filter("_skills", lambda s: F.exists(
        "_pref", lambda r: skill_hit(s, r)
        & ~F.exists(F.filter("_skills", lambda o: o["norm"] == s["norm"]), lambda o: exact_hit(o, r))
        & ~earlier_exact(s, r))), lambda s: s["norm"]))
    df = df.withColumn("_synonym", F.array_union(synonym_only(F.col("_req")), preferred_synonyms))
    matched = F.transform(F.array_union("_exact", "_synonym"), lambda n: F.struct(
        n.alias("norm"), mark_word(n).alias("mark")))
    df = df.withColumn("_matched", matched)

    def missing(lines: Column) -> Column:
        return F.transform(F.filter(lines, lambda r: ~F.exists(
            "_matched", lambda m: text_match(m["norm"], r["norm"], r["is_cert"], r["mark"], m["mark"]))),
            lambda r: r["norm"])

    norms = lambda array: F.transform(array, lambda r: r["norm"])
    candidate = F.array_sort(F.concat(F.array_distinct(norms(F.col("_skills"))), F.col("_certs")))
    analysis = F.struct(
        candidate.alias("normalized_candidate_skills"),
        norms(F.col("_req")).alias("normalized_required_skills"),
        norms(F.col("_pref")).alias("normalized_preferred_skills"),
        F.array_sort("_exact").alias("exact_matches"),
        F.array_sort("_synonym").alias("synonym_matches"),
        missing(F.col("_req")).alias("missing_required_skills"),
        missing(F.col("_pref")).alias("missing_preferred_skills"),
        F.array_except(candidate, F.array_union(norms(F.col("_req")), norms(F.col("_pref"))))
        .alias("additional_candidate_skills"))
    return df.withColumn("skill_analysis", analysis).select(*pairs.columns, "skill_analysis")


# ------------------------------------------------------------------ job side

def constituents(requirement: Column, technical_skills: Column) -> Column:
    """The technical skills named inside a requirement line, generic words excluded.

    Boundaries are letters and digits only. Tried on the line as written, then with
    ``- _ /`` read as spaces on both sides.
    """
    def named(skill: Column, text: Column) -> Column:
        pattern = F.concat(F.lit(r"(?<![a-zA-Z0-9])\Q"), skill, F.lit(r"\E(?![a-zA-Z0-9])"))
        return F.rlike(text, pattern)

    def spaced(c: Column) -> Column:
        return F.regexp_replace(c, "[-_/]", " ")

    kept = F.filter(F.transform(technical_skills, strip), lambda t: (F.length(t) >= 2)
                    & ~in_words(F.lower(t), GENERIC_SKILL_WORDS))
    line = F.lower(requirement)
    texts = F.struct(line.alias("line"), spaced(line).alias("spaced"))
    return let(texts, lambda x: F.filter(kept, lambda t: named(F.lower(t), x["line"])
                                         | named(spaced(F.lower(t)), x["spaced"])))


def _ontology_terms() -> tuple[list[str], list[str], list[str]]:
    terms = sorted({t for words in ONTOLOGY.values() for t in words})
    many = [t for t in terms if " " in t]
    alpha = [t for t in terms if " " not in t and t.isalpha()]
    return many, alpha, [t for t in terms if " " not in t and not t.isalpha()]


def ontology_terms_in_text(text: Column) -> Column:
    """Ontology terms that a line names as technology, sorted.

    Terms of several words match as substrings with ``- _ /`` read as spaces. A purely
    alphabetic term counts by its first whole-word occurrence, unless that is all lower
    case (``go``, ``react`` in prose). Terms with digits or symbols need letter/digit
    boundaries and ignore case.
    """
    many, alpha, symbol = _ontology_terms()

    def as_spaced(term: str) -> str:
        return "".join(" " if ch in "-_/" else ch for ch in term)

    many_terms = records({"term": t, "find": as_spaced(t)} for t in many)
    alpha_terms = records({"term": t, "find": py_mark_literal(t)} for t in alpha)
    symbol_terms = records(
        {"term": t, "find": "(?<![a-zA-Z0-9])" + _quote(as_spaced(t)) + "(?![a-zA-Z0-9])"} for t in symbol)
    marked = mark_bounds(text)
    prepared = F.struct(F.regexp_replace(F.lower(text), "[-_/]", " ").alias("spaced"), marked.alias("marked"),
                        F.lower(marked).alias("low"))

    def capitalised(t: Column, x: Column) -> Column:
        at = F.position(t["find"], x["low"])
        found = F.substr(x["marked"], at + 1, F.length(t["term"]))
        return (at > 0) & (found != F.lower(found))

    def found(x: Column) -> Column:
        hits = F.concat(
            F.filter(many_terms, lambda t: F.contains(x["spaced"], t["find"])),
            F.filter(alpha_terms, lambda t: capitalised(t, x)),
            F.filter(symbol_terms, lambda t: F.rlike(x["spaced"], t["find"])))
        return F.array_sort(F.transform(hits, lambda t: t["term"]))

    return let(prepared, found)


def _quote(text: str) -> str:
    return "\\Q" + text + "\\E"


def critical_skills(requirements: Column, line_terms: Column, n: int = 2) -> tuple[Column, Column]:
    """The critical skills of a job, and whether they are ontology terms.

    The first ``n`` ontology terms, in alphabetical order, of all required lines; if the
    lines name none, the first ``n`` lines themselves. ``line_terms`` holds the ontology
    terms of each line.
    """
    terms = F.array_sort(F.array_distinct(F.flatten(line_terms)))
    atomic = F.size(terms) > 0
    return F.when(atomic, F.slice(terms, 1, n)).otherwise(F.slice(requirements, 1, n)), atomic


def _similarity_tables() -> dict[str, dict[str, float]]:
    table: dict[str, dict[str, float]] = {}
    for a, b, value in SIMILAR_SKILLS:
        table.setdefault(a, {})[b] = value
        table.setdefault(b, {})[a] = value
    return table


def _similar_to(c: Column) -> Column:
    """Similarities of one name to all others, as a map."""
    return F.try_element_at(constant(_similarity_tables()), c)


def _meaningful(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: (F.length(w) >= 3) & ~in_words(w, COMPOSITE_STOPWORDS)
                    & ~in_words(w, BROAD_TERMS))


def _ascii_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), F.lit(1))


def requirement_unit(text: Column) -> Column:
    """Everything the ladder needs to know about one requirement."""
    norm = lower_strip(text)
    canon = lookup(norm, ALIAS_OF)
    sim = lookup(norm, SIMILARITY_SYNONYMS)
    groups = {member: group for group in COMPETITOR_GROUPS for member in group}
    group_of_canon = list_lookup(canon, groups)
    return F.struct(
        text.alias("text"), norm.alias("norm"), canon.alias("canon"),
        (is_cert_text(norm) | in_words(norm, CERT_ALIASES) | in_words(norm, CERT_OF)).alias("is_cert"),
        lookup(norm, CERT_OF).alias("cert"),
        list_lookup(canon, EQUIVALENT_DOMAINS).alias("equivalent"),
        list_lookup(canon, SUPPORTED_DOMAINS).alias("supported"),
        F.when(F.size(group_of_canon) > 0, group_of_canon).otherwise(list_lookup(norm, groups)).alias("rivals"),
        F.array_distinct(_meaningful(_ascii_words(norm))).alias("tokens"),
        mark_bounds(norm).alias("mark"),
        sim.alias("sim"), mark_bounds(sim).alias("sim_mark"), mark_literal(sim).alias("sim_find"),
        _similar_to(sim).alias("similar"))


def prepare_jobs(jobs: DataFrame) -> DataFrame:
    """M15, M17-M19 and the units of the ladder: add ``critical, atomic, units``.

    ``units`` has one entry per required line (weight 1.0 if critical, else 0.8), then
    per preferred line (0.4); "None specified" is skipped. Each carries its constituents
    as units of their own.
    """
    no_list = _empty()
    required = F.coalesce("requirements", no_list)
    preferred = F.filter(F.coalesce("preferred_skills", no_list), lambda p: F.lower(p) != "none specified")
    tech = F.coalesce("technical_skills", no_list)

    def parsed(text: Column) -> Column:
        return F.struct(requirement_unit(text).alias("unit"),
                        F.transform(constituents(text, tech), requirement_unit).alias("parts"))

    df = jobs.withColumn("_terms", F.transform(required, ontology_terms_in_text))
    critical, atomic = critical_skills(required, F.col("_terms"))
    # Required lines first; a preferred line has no ontology terms here (null).
    lines = F.concat(
        F.zip_with(required, "_terms", lambda r, t: F.struct(r.alias("text"), t.alias("terms"))),
        F.transform(preferred, lambda p: F.struct(p.alias("text"), F.lit(None).cast("array<string>").alias("terms"))))
    df = df.withColumn("critical", critical).withColumn("atomic", atomic).withColumn("_lines", F.transform(
        lines, lambda x: F.struct(x["terms"].alias("terms"), parsed(x["text"]).alias("p"))))

    def unit(x: Column, i: Column, job: Column) -> Column:
        required = x["terms"].isNotNull()
        crit = required & F.when(job["atomic"], F.arrays_overlap(x["terms"], job["critical"])).otherwise(i < 2)
        return F.struct(
            i.cast("long").alias("idx"), required.alias("required"), crit.alias("is_critical"),
            F.when(crit, 1.0).when(required, 0.8).otherwise(0.4).alias("weight"),
            F.coalesce(F.array_intersect(job["critical"], x["terms"]), no_list).alias("critical_named"),
            x["p"]["unit"].alias("unit"), x["p"]["parts"].alias("parts"))

    job = F.struct("critical", "atomic")
    return df.withColumn("units", let(job, lambda j: F.transform(
        "_lines", lambda x, i: unit(x, i, j)))).drop("_terms", "_lines")


def requirement_weights(prepared: DataFrame) -> DataFrame:
    """M19 as rows."""
    return prepared.select("job_id", F.explode("units").alias("u")).select(
        "job_id", F.col("u.idx").alias("req_idx"), F.col("u.unit.text").alias("requirement"),
        F.col("u.weight").alias("weight"), F.col("u.is_critical").alias("is_critical"))


# ------------------------------------------------------------------ candidate side

def prepare_candidates(profile: DataFrame) -> DataFrame:
    """Add ``skill_units, cert_units, title_texts, career_lower`` to ``build_profile`` rows."""
    def unit(s: Column, i: Column) -> Column:
        norm = lower_strip(s["name"])
        canon = lookup(norm, ALIAS_OF)
        sim = lookup(norm, SIMILARITY_SYNONYMS)
        return F.struct(
            i.alias("pos"), s["name"].alias("name"), s["proficiency"].alias("proficiency"),
            F.coalesce(s["duration_months"], F.lit(0)).alias("months"),
            norm.alias("norm"), canon.alias("canon"),
            _meaningful(F.array_union(_ascii_words(norm), _ascii_words(canon))).alias("words"),
            mark_literal(norm).alias("find"), mark_literal(canon).alias("canon_find"),
            sim.alias("sim"), mark_bounds(sim).alias("sim_mark"), mark_literal(sim).alias("sim_find"))

    def cert_unit(c: Column) -> Column:
        norm = lower_strip(c["name"])
        return F.struct(c["name"].alias("name"), norm.alias("norm"), lookup(norm, CERT_OF).alias("cert"))

    titles = F.concat(
        F.array(lower_strip(F.col("current_title"))),
        F.transform(F.filter("career_history", lambda j: j["title"].isNotNull() & (j["title"] != "")),
                    lambda j: lower_strip(j["title"])))
    certs = F.coalesce("certifications", F.array().cast("array<struct<name:string,issuer:string,year:int>>"))
    return profile.withColumns({
        "skill_units": F.transform("skills", unit),
        "cert_units": F.transform(certs, cert_unit),
        "title_texts": titles,
        "career_lower": F.lower("career_text"),
    })


# ------------------------------------------------------------------ the ladder

def _hit(cls, rung: str, skill: Column | None = None, measure: Column | None = None, cert: bool = False) -> Column:
    if skill is None:
        evidence = F.lit(None).cast("struct<name:string,proficiency:string,months:int,is_cert:boolean>")
    elif cert:
        evidence = F.struct(skill["name"].alias("name"), F.lit(None).cast("string").alias("proficiency"),
                            F.lit(None).cast("int").alias("months"), F.lit(True).alias("is_cert"))
    else:
        evidence = F.struct(skill["name"].alias("name"), skill["proficiency"].alias("proficiency"),
                            skill["months"].alias("months"), F.lit(False).alias("is_cert"))
    return F.struct(
        (F.lit(cls) if isinstance(cls, str) else cls).alias("cls"), F.lit(rung).alias("rung"),
        evidence.alias("skill"),
        (F.lit(None).cast("double") if measure is None else measure).alias("measure"))


def _skills() -> Column:
    return F.col("skill_units")


def in_career_text(u: Column) -> Column:
    text = F.col("career_lower")
    return F.contains(text, u["norm"]) | F.contains(text, u["canon"])


def rung_cert(u: Column) -> Column:
    """A certification requirement is met by certifications only, up to aliases."""
    found = _first(F.col("cert_units"), lambda c: (c["cert"] == u["cert"]) | (c["norm"] == u["norm"]),
                   lambda c: _hit("DIRECT", "cert", c, cert=True))
    return F.when(u["is_cert"], F.coalesce(found, _hit("NONE", "cert")))


def rung_direct(u: Column) -> Column:
    """M07, rung A: a skill tag equal to the requirement, up to aliases."""
    return _first(_skills(), lambda s: (s["canon"] == u["canon"]) | (s["norm"] == u["norm"]),
                  lambda s: _hit("DIRECT", "A", s))


def _family_rank(text: Column, canon: Column) -> Column:
    """Index of the first pattern of the family that the text shows; null if none."""
    arms = [
        ((canon == family) & text.rlike("(?U)" + pattern), i)
        for family, patterns in FAMILY_PATTERNS.items() for i, pattern in enumerate(patterns)]
    return reduce(lambda acc, arm: acc.when(arm[0], arm[1]), arms[1:], F.when(arms[0][0], arms[0][1]))


def rung_family(u: Column) -> Column:
    """M08, rung B: a version or model family name among the skill tags."""
    ranked = F.transform(_skills(), lambda s: F.struct(
        _family_rank(s["norm"], u["canon"]).alias("rank"), s["pos"].alias("pos"), s.alias("s")))
    found = F.array_sort(F.filter(ranked, lambda x: x["rank"].isNotNull()))
    hit = F.get(F.transform(F.slice(found, 1, 1), lambda x: _hit("DIRECT", "B", x["s"])), F.lit(0))
    return F.when(in_words(u["canon"], FAMILY_PATTERNS), hit)


def rung_family_text(u: Column) -> Column:
    """M08, rung E: the family is only named in the career text."""
    named = in_words(u["canon"], FAMILY_PATTERNS) & _family_rank(F.col("career_lower"), u["canon"]).isNotNull()
    return F.when(named, _hit("SUPPORTED", "E"))


def rung_title(u: Column) -> Column:
    """M09, rung C: a title names the requirement; skills or text must back it up."""
    claim = F.exists("title_texts", lambda t: F.contains(t, u["canon"]) | F.contains(t, u["norm"]))
    backed = F.exists(_skills(), lambda s: F.array_contains(u["equivalent"], s["canon"])
                      | F.array_contains(u["supported"], s["canon"])) | F.exists(
        u["equivalent"], lambda d: F.contains(F.col("career_lower"), d))
    return F.when(claim, F.when(backed, _hit("EQUIVALENT", "C")).otherwise(_hit("SUPPORTED", "C")))


def rung_domain(u: Column) -> Column:
    """M10, rung D: a skill of an equivalent, else of a supporting domain."""
    equal = _first(_skills(), lambda s: F.array_contains(u["equivalent"], s["canon"]),
                   lambda s: _hit("EQUIVALENT", "D", s))
    support = _first(_skills(), lambda s: F.array_contains(u["supported"], s["canon"]),
                     lambda s: _hit("SUPPORTED", "D", s))
    return F.coalesce(equal, support)


def rung_competitor(u: Column) -> Column:
    """M11, rung F: a rival technology; better if the text names the required one."""
    def rival(s: Column) -> Column:
        member = F.array_contains(u["rivals"], s["canon"]) | F.array_contains(u["rivals"], s["norm"])
        return member & (s["canon"] != u["canon"]) & (s["norm"] != u["norm"])
    return _first(_skills(), rival, lambda s: F.when(in_career_text(u), _hit("SUPPORTED", "F", s))
                  .otherwise(_hit("RELATED", "F")))


def rung_composite(u: Column) -> Column:
    """M12, rung G: skills named in a long requirement cover at least 60 % of its words."""
    named = F.filter(_skills(), lambda s: ((F.length(s["norm"]) >= 3) & bounded_in(s["find"], u["mark"]))
                     | ((F.length(s["canon"]) >= 3) & bounded_in(s["canon_find"], u["mark"])))
    held = F.transform(F.array(named), lambda m: F.struct(
        F.get(m, F.lit(0)).alias("s"),
        (F.size(F.array_distinct(F.flatten(F.transform(m, lambda s: s["words"])))) / F.size(u["tokens"])).alias("cover")))
    hit = _first(held, lambda h: h["cover"] >= 0.60, lambda h: _hit("EQUIVALENT", "G", h["s"], h["cover"]))
    return F.when(F.size(u["tokens"]) >= 3, hit)


def skill_similarity(s: Column, u: Column) -> Column:
    """Equal, or one inside the other between word boundaries: 1.0; else the table; else 0."""
    same = (s["norm"] == u["norm"]) | (s["sim"] == u["sim"]) | bounded_in(s["sim_find"], u["sim_mark"]) \
        | bounded_in(u["sim_find"], s["sim_mark"])
    return F.when(same, 1.0).otherwise(F.coalesce(F.try_element_at(u["similar"], s["sim"]), F.lit(0.0)))


def rung_similarity(u: Column) -> Column:
    """M13, rung H: the most similar skill. A broad term only relates; from 0.70 on the
    text decides between SUPPORTED and RELATED. Weaker similarity falls through."""
    scored = F.transform(_skills(), lambda s: F.struct(
        skill_similarity(s, u).alias("sim"), (-s["pos"]).alias("order"), s.alias("s")))
    # ``order`` is unique, so the skill itself never decides the maximum.
    best = F.array(F.array_max(scored))
    return _first(
        best, lambda b: b.isNotNull() & (b["sim"] > 0) & (b["s"]["norm"] != "")
        & ((b["sim"] >= 0.70) | in_words(b["s"]["norm"], BROAD_TERMS)),
        lambda b: F.when(in_words(b["s"]["norm"], BROAD_TERMS), _hit("RELATED", "H", measure=b["sim"]))
        .when(in_career_text(u), _hit("SUPPORTED", "H", b["s"], b["sim"]))
        .otherwise(_hit("RELATED", "H", measure=b["sim"])))


def rung_text(u: Column) -> Column:
    """M13, rung I: the career text names the requirement."""
    return F.when(in_career_text(u), _hit("SUPPORTED", "I"))


RUNGS = [
    rung_cert, rung_direct, rung_family, rung_title, rung_domain, rung_family_text,
    rung_competitor, rung_composite, rung_similarity, rung_text,
]


def ladder(u: Column) -> Column:
    """The first rung that decides; NONE if no rung does. Later rungs are not evaluated."""
    return F.coalesce(*[rung(u) for rung in RUNGS], _hit("NONE", "-"))


def explain_rung(pairs: DataFrame, rung: Callable[[Column], Column]) -> DataFrame:
    """One rung alone, as rows ``job_id, candidate_id, req_idx, cls, skill, measure``."""
    return pairs.select("job_id", "candidate_id", F.explode(F.filter(F.transform(
        "units", lambda x: F.struct(x["idx"].alias("idx"), rung(x["unit"]).alias("hit"))),
        lambda x: x["hit"].isNotNull())).alias("x")).select(
        "job_id", "candidate_id", F.col("x.idx").alias("req_idx"), F.col("x.hit.cls").alias("cls"),
        F.col("x.hit.skill.name").alias("skill"), F.col("x.hit.measure").alias("measure"))


# ------------------------------------------------------------------ constituents

def proficiency_rank(skill: Column) -> Column:
    level = F.lower(F.coalesce(skill["proficiency"], F.lit("")))
    return F.when(level.contains("expert"), 1.2).when(level.rlike("advanced|lead"), 1.1).otherwise(1.0)


def classify(pairs: DataFrame) -> DataFrame:
    """Add ``classified``, one entry per requirement unit.

    A requirement that ends as NONE or RELATED takes over its best constituent that is
    DIRECT or EQUIVALENT (by proficiency, then months, then order); a NONE takes over
    its first SUPPORTED constituent. ``via`` names the constituent.
    """
    def own(x: Column) -> Column:
        return F.struct(x.alias("x"), ladder(x["unit"]).alias("hit"))

    def part_results(y: Column) -> Column:
        parts = F.transform(y["x"]["parts"], lambda p, i: F.struct(
            p["text"].alias("text"), i.alias("pos"), ladder(p).alias("hit")))
        return F.struct(y["x"].alias("x"), y["hit"].alias("hit"), F.when(
            y["hit"]["cls"].isin("NONE", "RELATED"), parts).alias("parts"))

    def best_part(z: Column) -> Column:
        strong = F.filter(z["parts"], lambda p: p["hit"]["cls"].isin("DIRECT", "EQUIVALENT"))
        best = F.array_max(F.transform(strong, lambda p: F.struct(
            proficiency_rank(p["hit"]["skill"]).alias("prof"),
            F.coalesce(p["hit"]["skill"]["months"], F.lit(0)).alias("months"), (-p["pos"]).alias("order"),
            p.alias("p"))))["p"]
        supported = F.get(F.filter(z["parts"], lambda p: p["hit"]["cls"] == "SUPPORTED"), F.lit(0))
        return F.struct(z["x"].alias("x"), z["hit"].alias("hit"), F.coalesce(
            best, F.when(z["hit"]["cls"] == "NONE", supported)).alias("part"))

    def result(w: Column) -> Column:
        x, hit, part = w["x"], w["hit"], w["part"]
        strong_part = part["hit"]["cls"].isin("DIRECT", "EQUIVALENT")
        final = F.coalesce(part["hit"], hit)
        strong_own = part.isNull() & hit["cls"].isin("DIRECT", "EQUIVALENT")
        # Which critical skills this line proves (atomic mode): those named in the line,
        # once it is met as a whole or by a constituent.
        proves = F.when(x["is_critical"] & (strong_own | F.coalesce(strong_part, F.lit(False))),
                        F.when(F.col("atomic"), x["critical_named"]).otherwise(F.array(x["unit"]["text"]))
                        ).otherwise(_empty())
        return F.struct(
            x["idx"].alias("idx"), x["unit"]["text"].alias("requirement"), x["unit"]["norm"].alias("norm"),
            x["required"].alias("required"), x["is_critical"].alias("is_critical"), x["weight"].alias("weight"),
            final["cls"].alias("cls"), final["rung"].alias("rung"), final["skill"].alias("skill"),
            final["measure"].alias("measure"), part["text"].alias("via"), proves.alias("proves"))

    steps = F.transform(F.transform(F.transform("units", own), part_results), best_part)
    return pairs.withColumn("classified", F.transform(steps, result))


# ------------------------------------------------------------------ cohort statistics

def skill_mentions(cohort: DataFrame) -> DataFrame:
    """``job_id, skill`` for every skill of every cohort row, and once more with a null skill for the row itself."""
    names = F.transform("skills", lambda s: lower_strip(s["name"]))
    return cohort.select("job_id", F.explode(F.concat(F.array(F.lit(None).cast("string")), names)).alias("skill"))


def rarity_of(counted: DataFrame) -> DataFrame:
    """``job_id, skill, rarity`` from the numbers ``n`` of mentions."""
    sizes = counted.filter("skill IS NULL").select("job_id", F.col("n").alias("cohort"))
    value = 1.0 + (1.0 - F.col("n") / F.col("cohort"))
    return counted.filter("skill IS NOT NULL").join(sizes, "job_id").select(
        "job_id", "skill", F.greatest(F.lit(1.0), F.least(F.lit(2.0), value)).alias("rarity"))


def skill_rarity(cohort: DataFrame) -> DataFrame:
    """``job_id, skill, rarity``: 2 minus the share of cohort rows, between 1 and 2.

    Every occurrence counts. A marker entry per row carries the cohort size in the same
    partially aggregated shuffle.
    """
    return rarity_of(skill_mentions(cohort).groupBy("job_id", "skill").agg(F.count("*").alias("n")))


def attach_rarity(prepared_jobs: DataFrame, rarity: DataFrame) -> DataFrame:
    """Give each job the rarity of its own requirement names, as a small map."""
    wanted = prepared_jobs.select("job_id", F.explode("units").alias("u")).select(
        "job_id", F.col("u.unit.norm").alias("skill")).distinct()
    maps = wanted.join(rarity, ["job_id", "skill"]).groupBy("job_id").agg(
        F.map_from_entries(F.collect_list(F.struct("skill", "rarity"))).alias("rarity"))
    return prepared_jobs.join(maps, "job_id", "left").withColumn(
        "rarity", F.coalesce("rarity", F.create_map().cast("map<string,double>")))


# ------------------------------------------------------------------ lists for output

def match_lists() -> tuple[Column, Column]:
    """``matched_skills, missing_skills`` of a scored row.

    Exact and synonym matches (else the tier lists); missing lines without those that
    any matched list holds; first occurrences in order.
    """
    analysis = F.col("skill_analysis")
    empty = _empty()
    got = F.coalesce(F.concat(analysis["exact_matches"], analysis["synonym_matches"]), empty)
    tiers = F.concat("critical_skills_matched", "important_skills_matched", "nice_to_have_skills_matched")
    matched = F.array_distinct(F.when(F.size(got) > 0, got).otherwise(tiers))
    lost = F.coalesce(F.concat(analysis["missing_required_skills"], analysis["missing_preferred_skills"]), empty)
    missing = F.when(F.size(lost) > 0, F.array_distinct(lost)).otherwise(F.col("missing_critical_skills"))
    known = F.transform(F.concat(tiers, matched), lower_strip)
    return matched, F.filter(missing, lambda s: ~F.array_contains(known, lower_strip(s)))


def requirement_coverage(results: DataFrame) -> DataFrame:
    """Every requirement of the job with matched or not, from the match lists alone.

    Matched if some matched name equals it, holds it, is inside it, or stands in it as a
    whole word; a line listed as missing needs the whole-word form.
    """
    def names(*columns: str) -> Column:
        return F.array_distinct(F.transform(F.concat(*columns), lambda s: strip(F.lower(
            F.get(F.split(s, r" \(via"), F.lit(0))))))
    df = results.withColumn("_got", F.transform(names(
        "critical_skills_matched", "important_skills_matched", "nice_to_have_skills_matched", "matched_skills"),
        lambda m: F.struct(m.alias("name"), mark_literal(m).alias("find")))
    ).withColumn("_lost", names("missing_skills", "missing_critical_skills"))

    def row(text: Column, i: Column, required: bool) -> Column:
        name = F.lower(strip(text))
        mark = mark_bounds(name)
        inside = F.exists("_got", lambda m: (F.length(m["name"]) >= 2) & bounded_in(m["find"], mark))
        loose = F.exists("_got", lambda m: F.contains(m["name"], name) | F.contains(name, m["name"]))
        matched = inside | (~F.array_contains(F.col("_lost"), name) & loose)
        return F.struct(i.cast("long").alias("pos"), strip(text).alias("name"), F.lit(required).alias("required"),
                        matched.alias("matched"))
    required = F.transform("requirements", lambda r, i: row(r, i, True))
    preferred = F.transform("preferred_skills", lambda p, i: row(p, i, False))
    kept = F.filter(F.concat(required, preferred), lambda x: (x["name"] != "") & (
        x["required"] | (F.lower(x["name"]) != "none specified")))
    return df.select("job_id", "candidate_id", F.explode(kept).alias("x")).select(
        "job_id", "candidate_id", "x.pos", "x.name", "x.required", "x.matched")
