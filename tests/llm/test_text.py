"""Personal data, language, quality, pieces and pages against plain versions."""

import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from candisieve.llm import html_extract, language_id, pii, piece_bpe, quality
from candisieve.llm.common import word_hashes

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    return sum(v * 2 - 9 * (v > 4) if i % 2 else v for i, v in enumerate(map(int, reversed(number)))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


ODD = ["a.b%c@x.y.z_q@w.v x@y a@b@c.d @@ q@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255", "4111 1111 1111 1111 5 4111-1111-1111-1111 +1 (555) 123-4567 +4",
       "é😀 a@b.co 😀 10.0.0.1", None, "", "a@b.c d@e.f g@h.i", "+1234567890123456 +12345678", "1 2 3 4 " * 50, "a" * 50_000, "1" * 50_000,
       "ab@cd.ef " * 3_000, "1." * 20_000]


def test_spans_are_those_of_the_plain_patterns(spark):
    table = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumns({"email": F.lit(1), "_text": F.lit(2)})
    got = {r.doc_id: r.s for r in pii.find_personal_data(table).select("doc_id", pii.joined(*pii.BASE).alias("s")).collect()}
    assert got == {i: plain_spans(t or "") for i, t in enumerate(ODD)}


def test_check_sums_and_words_nearby(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432", "DE88370400440532013000", "credit card 4111111111111111", "order 4111111111111111"]
    got = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(s.start, s.end) for s in got[0].iban] == [(5, 32), (34, 56)] and got[1].iban == []
    assert got[0].iban[0].score > 0.9 and got[2].card[0].score > 0.7 > got[3].card[0].score
    masked = spark.createDataFrame([("mail a@b.co and c@d.e.",)], "t string").withColumn("s", pii.find_spans("email", F.col("t")))
    assert masked.select(pii.mask(F.col("t"), F.col("s")).alias("m")).first().m == "mail * and *."


def test_languages_are_told_apart(spark):
    rng = np.random.RandomState(3)
    words = {"aa": ["kora", "lima", "tuko"], "bb": ["strend", "wulfen", "krim"], "cc": ["eaux", "quelle", "tion"]}
    rows = [(i, " ".join(rng.choice(words[lang], 30)), lang) for i in range(150) for lang in [sorted(words)[i % 3]]]
    table = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 !?", "bb"), (902, "", None), (903, "kora lima", None), (903, "kora lima", None)],
                                  "doc_id long, text string, lang string")
    model = language_id.fit(table.where("doc_id % 2 = 0"))
    got = language_id.identify(table.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == 155 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert all(by[i] == lang for i, _, lang in rows) and by[900] == by[901] == by[902] == "und" and by[903] == "aa"
    kept = language_id.keep_identified(table, model)
    assert kept.columns == table.columns and kept.count() == 152
    assert language_id.fit(table.where("doc_id < 0")) is None
    assert {r.lang_pred for r in language_id.identify(table, None).collect()} == {"und"}
    assert language_id.identify(table.where("doc_id < 0"), model).isEmpty()


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 9, 40):
        code = language_id.codewords(n)
        assert all((code[a] != code[b]).sum() >= code.shape[1] // 2 for a in range(n) for b in range(a))


def test_quality_is_learned(spark):
    rng = np.random.RandomState(5)
    good, bad = ["the", "river", "runs", "north", "slowly"], ["buy|", "now|", "cheap|", "pills|"]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad, 40)), i % 2) for i in range(300)] + [(400, None, 1), (401, "", 0), (402, "ab ab " * 20_000, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    weights = quality.fit(table.where("doc_id < 200"))
    got = {r.doc_id: r.score for r in quality.score_quality(table.withColumn("w", F.lit(1)), weights).collect()}
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values()) and got[400] == got[401]
    assert all((got[i] >= 0.3) == bool(i % 2) for i in range(200, 300))
    assert quality.score_quality(table.where("doc_id < 0"), weights).isEmpty()
    assert not quality.fit(table.where("label is null")).any()


def test_copies_take_one_place_of_the_sample(spark):
    rows = [("copied text", 1)] * 3_000 + [("copied text", 0)] + [(f"text {i}", i % 2) for i in range(200)]
    table = spark.createDataFrame(rows, "text string, label int")
    taken = {(r.text, r.label): r.copies for r in quality.training_rows(table, most_rows=250).collect()}
    assert len(taken) == 202 and taken["copied text", 1] == 3_000 and sum(taken.values()) == len(rows)
    # Only 100 places: about half of the different texts, whichever way the copied one falls.
    assert 50 < quality.training_rows(table, most_rows=100).count() < 150


def test_copies_are_learned_as_single_rows_are():
    rows = [(np.array([1, 2, 9]), np.array([4.0, 6.0, 1.0])), (np.array([2, 3, 9]), np.array([5.0, 5.0, 1.0]))]
    once = quality.train(iter([rows[0]] * 5 + [rows[1]]), np.array([1] * 5 + [0]))
    assert (quality.train(iter(rows), np.array([1, 0]), copies=np.array([5, 1])) == once).all()
    many = quality.train(iter(rows), np.array([1, 0]), copies=np.array([10**7, 1]))
    assert np.isfinite(many).all() and many[1] > 0 > many[3]


def test_word_hashes_know_their_text():
    texts = ["A b\tc", "", "  b ", "c", "a\x0bb"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    hashes, first = word_hashes(raw, np.cumsum([0] + [len(t) for t in texts]))
    assert first.tolist() == [0, 3, 3, 4, 5, 7]
    assert hashes[0] == hashes[5] and hashes[1] == hashes[3] == hashes[6] and hashes[2] == hashes[4] and len(set(hashes.tolist())) == 3


PIECES = pytest.importorskip("public_tokenizers")


def test_ids_are_those_of_the_library(spark):
    model = PIECES.path("piece_bpe_32k.model")
    texts = ["", None, " ", "  a", "a  b   c", "\n", "é😀🎉 日本語 テスト", "▁▁a ▁", "a.b,c!!! $$$ %%%", "x" * 3_000, "\t\t\n \x00 \x01", "the.The,and;or(a)b[c]",
             "ab" * 5_000, "0123456789" * 20, "don't it's", "<s> </s> <0x41> <unk>", "hello world", "hello world"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    library = piece_bpe.PieceEncoder(model).library
    for r in piece_bpe.encode_documents(table, model).collect():
        ids = [1, *library.encode(texts[r.doc_id] or ""), 2]
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
    assert piece_bpe.encode_documents(table.where("doc_id < 0"), model).isEmpty()


def page(body, title="t"):
    return f"<html><head><title>{title}</title><style>x</style></head><body>{body}</body></html>"


def test_main_text_of_a_page():
    body = ("<header>Site</header><nav>menu</nav><div id='cookie-notice'>cookies</div><div class=sidebar>side</div><main><article><header><h1>T &amp; t</h1></header>"
            "<p>a<b>b</b>&nbsp; c<p>d<br>e<ul><li>x<li>y</ul><aside>no</aside><div class='comments'><p>bad</p></div><form>f</form>"
            "<script>var t='</p>';</script></article></main><footer>f</footer>")
    assert html_extract.Page(page(body)).main_text() == "T & t ab c d e x y"
    assert html_extract.Page("plain &lt;text&gt; only <div>z").main_text() == "plain <text> only z"
    assert html_extract.Page("").main_text() == "" and html_extract.Page("<!-- x").main_text() == ""


@pytest.mark.parametrize("html", [
    "<form id=aspnetForm><input type=hidden value=x><div>menu</div><article><p>body</p></article><p>end</p></form>",
    "<form><p>body</p></form>", "<div class='sidebar-layout'><p>top</p><main><p>body</p></main></div>",
    "<div>top</div><div class='sidebar-layout'><article><p>body text</p></article></div>", "<div id='menu-page'><p>body</p></div>",
    "<nav>menu<article><p>body</p></article>", "<div class=ad>buy<article><p>body</p></article><p>more", "<aside>x<main>body</main>",
    "<main><h1>top</h1><nav>menu<article>body</article></main>", "<nav><p>body</p>", "<select><option>a<article><p>body</p></article>",
    "<select><option>a<article><p>body</p></article><select><option>b</select>", "<svg><path d=x><p>body</p>", "<svg><g><p>body</p><svg><g></g></svg>",
    "<object data=x><p>body</p>", "<math><mi><p>body</p>", "<script>var a = 1;<p>body</p>"])
def test_a_body_in_a_dropped_or_open_element_is_kept(html):
    text = html_extract.Page(page(html)).main_text()
    assert "body" in text and not {"buy", "top", "var"} & set(text.split())


def test_articles_that_are_no_body_stay_away():
    read = lambda html: html_extract.Page(page(html)).main_text()
    assert read("<article><p>body</p><div class=comments><article>said</article></div></article><aside><article>teaser</article></aside>") == "body"
    assert read("<article>body</article><div id=comments><div><article>said</article></div>") == "body"
    assert read("<main>body</main><div class=related><article>a much longer teaser</article></div>") == "body"
    assert read("<div class=page-sidebar><article>body<div class=comments><article>said</article></div></article></div>") == "body"
    assert read("<p>body<select><option>a</select><svg><foreignObject><p>no</p></foreignObject></svg><nav>menu</nav><form>f</form>") == "body"
    assert read("<nav>menu</nav><form><input></form>") == "" and read("<div hidden>x</div>") == ""


def test_templates_of_a_site_go_and_repeated_articles_stay(spark):
    box = "<div><div>Our site</div><div>All rights</div></div>"
    rows = [(i, f"http://h.example/{i}", page(box + f"<div><p>story {i}</p><p>same end</p></div>" if i % 2 else box + f"<div><p>other {i}</p></div>", f"t{i}"))
            for i in range(12)]
    rows += [(100 + i, "http://copy.example/x", page("<div><p>one article</p></div>", "same")) for i in range(20)]
    rows += [(200, None, None), (201, "", ""), (202, "x", page("<p>alone</p>"))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z"))
    got = {r.page_id: r.text for r in html_extract.extract_main_text(table).collect()}
    assert len(got) == len(rows) and got[0] == "other 0" and got[1].startswith("story 1") and "site" not in got[1]
    assert got[100] == "one article" and got[200] == got[201] == "" and got[202] == "alone"
    assert html_extract.extract_main_text(table.where("page_id < 0")).isEmpty()


def test_templates_are_counted_over_pages_not_titles(spark):
    notice = "<div><div>All the news</div></div>"
    rows = [(i, f"http://one.example/{i}", page(notice + f"<div><p>story {i}</p></div>", "One title")) for i in range(12)]
    # Under the share of a large host, a section's notice is a template by its number of pages.
    rows += [(100 + i, f"http://hot.example/{i}", page((notice if i < 20 else "") + f"<div><p>story {i}</p></div>", f"t{i}")) for i in range(100)]
    # An article that a host repeats under changing surroundings counts once.
    rows += [(300 + i, f"http://copy.example/{i}", page(f"<div>ad {i}</div><article><p>one article</p></article>")) for i in range(20)]
    # Versions of an article have its heading in common, which stays; a box that other articles have too goes.
    rows += [(400 + i, f"http://version.example/{i}", page(f"<article><h1>{'News' if i < 6 else i}</h1><p>version {i}</p><div>Read on</div></article>", "News" if i < 6 else f"t{i}"))
             for i in range(12)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_main_text(table, many_pages=20).collect()}
    assert all(got[i] == f"story {i}" for i in range(12))
    assert all(got[100 + i] == f"story {i}" for i in range(100))
    assert all(got[300 + i] == "one article" for i in range(20))
    assert got[400] == "News version 0" and got[405] == "News version 5" and got[411] == "11 version 11"
    got = {r.page_id: r.text for r in html_extract.extract_main_text(table, many_pages=21).collect()}
    assert got[100] == "All the news story 0" and got[0] == "story 0"


def test_given_pages_read_as_their_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_extract.extract_main_text(rows).join(rows, ["page_id", "url"]).collect():
        inside = r.html[r.html.find("<article>") + 9: r.html.find("</article>")]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"<(?:/?p|/?h1|br)>", inside)]
        assert r.text == " ".join(b for b in blocks if b)
