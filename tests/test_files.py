"""Files as they come: ranked lists with their header line, postings, synonyms."""

from candisieve.operators import quality
from candisieve.sources.postings import read_postings
from candisieve.sources.results import read_submission_cells, read_submission_headers
from candisieve.sources.synonyms import read_synonyms

HEAD = "candidate_id,rank,score,reasoning"


def test_header_lines_and_cells(spark, tmp_path):
    rows = ["CAND_0000001,1,9.5,\"first, and best\"", "", HEAD, "CAND_0000002,2,\"8\",second", ",,,", "CAND_0000003,3"]
    (tmp_path / "a.csv").write_text("\n".join([HEAD, *rows]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(["candidate_id,score,rank,reasoning", rows[0]]) + "\n")
    heads = read_submission_headers(spark, str(tmp_path))
    assert {r.file.rsplit("/", 1)[1]: r.header for r in heads.collect()} == {
        "a.csv": HEAD.split(","), "b.csv": ["candidate_id", "score", "rank", "reasoning"]}
    cells = read_submission_cells(spark, str(tmp_path / "a.csv")).orderBy("row_num").collect()
    assert [(r.n_cells, r.candidate_id, r["rank"], r.score, r.reasoning) for r in cells] == [
        (4, "CAND_0000001", "1", "9.5", "first, and best"), (4, *HEAD.split(",")), (4, "CAND_0000002", "2", "8", "second"),
        (2, "CAND_0000003", "3", None, None)]
    found = quality.check_header(heads.withColumnRenamed("file", "list"), ["list"]).collect()
    assert [(r["list"].rsplit("/", 1)[1], r.rule, r.row_key) for r in found] == [("b.csv", "header", "candidate_id,score,rank,reasoning")]


def test_header_is_one_of_the_violations(spark):
    sub = spark.createDataFrame([(1, n, 4, f"CAND_{n:07d}", str(n), str(200 - n)) for n in range(1, 101)],
                                "job_id long, row_num long, n_cells long, candidate_id string, rank string, score string")
    heads = spark.createDataFrame([(1, None)], "job_id long, header array<string>")
    assert [(r.job_id, r.rule, r.row_key) for r in quality.violations(sub, heads, ["job_id"]).collect()] == [(1, "header", "")]
    heads = spark.createDataFrame([(1, HEAD.split(","))], "job_id long, header array<string>")
    assert quality.violations(sub, heads, ["job_id"]).isEmpty()


def test_posting_files(spark, tmp_path):
    for name, text in {"a.txt": "Job Title: Baker\nBread", "b.MD": "# Role", "c.pdf": "no", "d": "no"}.items():
        (tmp_path / name).write_text(text)
    assert {tuple(r) for r in read_postings(spark, str(tmp_path)).collect()} == {("a.txt", "Job Title: Baker\nBread"), ("b.MD", "# Role")}


def test_synonym_file(spark, tmp_path):
    path = tmp_path / "synonyms.json"
    assert read_synonyms(spark, str(path)).isEmpty()
    path.write_text('{"Pg-SQL": "PostgreSQL",\n "pg sql": "Postgres", "n": 3, "torch": "PyTorch"}')
    assert {tuple(r) for r in read_synonyms(spark, str(path)).collect()} == {("pg sql", "postgres"), ("torch", "pytorch")}
