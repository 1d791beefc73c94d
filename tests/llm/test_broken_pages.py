"""Broken pages of a megabyte are read in linear time; templates inside articles go by share alone."""

import time

import pytest
from pyspark.sql import functions as F

from candisieve.llm import html_extract
from candisieve.llm.html_extract import Page, Tags

SIZE = 1_000_000
SHAPES = [
    "<a", "<div ", "<p>a<form>", "<b>a", "<b>a<br>", "</form", "<a \">\" ", "<a '\" >", "<svg>", "<select><div>a", "<!", "<!--", "<td><form>",
    "<dl><dd>", "<nav><article>a", "<x class=ad><article>a", "<li><ul>", "<script>", "<title", "&#", "&#9999999999", "<a \"'", "class=\"", "<p class='ad\" >x", "<"]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("end", ["", "\">", "'\"", "</form></div>"])
def test_a_megabyte_of_broken_markup_is_read_in_time(shape, end):
    html = "<dl><p>" + shape * (SIZE // len(shape)) + end
    start = time.process_time()
    Page(html).main_text()
    assert time.process_time() - start < 20


def test_distinct_names_and_deep_nesting_are_read_in_time():
    start = time.process_time()
    Page("".join(f"<x{k} class=ad>" for k in range(60_000)) + "<article>a" * 10_000).main_text()
    Page("<dl>" + "<x>" * 150_000 + "<dt>a" * 60_000).main_text()
    Page("&#" + "9" * 1_000_000 + ";").main_text()
    assert time.process_time() - start < 40


def test_tags_end_outside_quotes():
    def names(html):
        found, at = [], 0
        tags = Tags(html)
        while tag := tags.next(at):
            found.append((tag[2], tag[3].strip(), tag[4]))
            at = tag[1]
        return found

    assert names('<a href="x>y">b</A><p title=\'it"s\'>') == [("a", 'href="x>y"', False), ("a", "", True), ("p", "title='it\"s'", False)]
    assert names('<a title="open><b>') == [("a", 'title="open', False), ("b", "", False)]
    assert names("3 < 4 <b <i>x") == [("b", "<i", False)]
    assert names("<!-- <b> --><?xml ?><i>") == [("", "", False), ("", "", False), ("i", "", False)]
    assert names("<b") == [] and names("<!-- <b>") == [("", "", False)]


def test_numbers_of_any_length_are_decoded():
    assert Page("<p>&#0000000000065;&#x41;&#99999999999999999999;&amp;</p>").main_text() == "AA�&"


def test_lines_inside_articles_stay_on_hosts_of_every_size(spark):
    pages = spark.range(1_300).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id")).alias("url"),
        F.concat(F.lit("<title>t"), F.col("id"), F.lit("</title><div><p>Same menu</p></div><article><p>Story "), F.col("id"), F.lit("</p>"),
                 F.when(F.col("id") % 4 == 0, "<p>Yes.</p>").otherwise(""), F.lit("</article>")).alias("html"))
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages, many_pages=300).collect()}
    assert all(got[k] == f"Story {k}" + (" Yes." if k % 4 == 0 else "") for k in range(1_300))
