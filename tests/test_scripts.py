"""Scripts, pages and chunks by hand, from the specification's words."""

from __future__ import annotations

from folio import catalogue
from folio.functions import splitting


def query(spark, name, **tables):
    frames = {t: spark.createDataFrame(rows, schema) for t, (rows, schema) in tables.items()}
    return catalogue.queries()[name].on(**frames).collect()


PLAY = [
    (1, 1, "Verona stands quiet"),
    (1, 2, "Enter SAMPSON"),
    (1, 3, "SAMPSON"),
    (1, 4, "We will not carry coals"),
    (1, 5, "No more of it"),
    (1, 6, "Lady Gray"),
    (1, 7, "GREGORY: No, for then"),
    (1, 8, "we were colliers"),
]


def test_lines_and_their_merging(spark):
    lines = {"play_lines": (PLAY, "conv_id long, line_no long, line string")}
    kinds = {r["line_no"]: r["kind"] for r in query(spark, "line_kinds", **lines)}
    assert kinds == {1: "other", 2: "stage", 3: "name", 4: "other", 5: "other", 6: "name", 7: "script", 8: "other"}
    merged = {r["line_no"]: (r["lines"], r["name"], r["text"]) for r in query(spark, "script_merge", **lines)}
    assert merged == {
        1: (1, None, "Verona stands quiet"),
        2: (1, None, "Enter SAMPSON"),
        3: (3, "SAMPSON", "SAMPSON: We will not carry coals No more of it"),
        6: (1, "Lady Gray", "Lady Gray"),
        7: (1, None, "GREGORY: No, for then"),
        8: (1, None, "we were colliers"),
    }


def test_paragraphs_go_by_line_or_as_a_whole(spark):
    lines = [(1, 4, "One line"), (1, 5, "Enter ALL"), (1, 6, "two"), (1, 7, "three"), (1, 8, "plain  words"), (1, 9, "only here")]
    got = {r["line_no"]: (r["paragraph"], r["lines"], r["chars"], r["kind"]) for r in query(spark, "paragraph_dispatch", play_lines=(lines, "conv_id long, line_no long, line string"))}
    assert got == {4: (1, 1, 8, "joined"), 5: (1, 1, 9, "stage"), 6: (1, 2, 8, "joined"), 8: (2, 2, 20, "narrative")}


PAGES = {
    1: ("", "empty"),
    2: ("<p>The Project Gutenberg EBook</p>", "pg_metadata"),
    3: ("<p>Chapter 3: The World 4.</p>", "chapter_nav"),
    4: ("<p>Chapter 1</p><p>Chapter 2</p><p>x</p>", "chapter_nav"),
    5: ("<p>web novel. thanks for reading</p>", "author_notes"),
    6: ("<p>views: 12, next chapter</p>", "chapter_nav"),
    7: ("<p>light novel, read more</p>", "platform_ui"),
    8: ("<p>translated by someone</p>", "web_metadata"),
    9: ("<p>Saintsbury holds so</p>", "preface"),
    10: ("<p>All rights reserved</p>", "metadata"),
    11: ("<p>12</p><p>a</p>", "metadata"),
    12: ("<p>" + "She went down to the old river and sat there for hours. " * 2 + "</p>", "story"),
    13: ("<p>Section nine</p>", "chapter_header"),
    14: ("<p>" + "word " * 60 + "introduction</p>", "preface"),
    15: ("<p>short</p>", "metadata"),
    16: ("<p>" + "word " * 60 + "</p>", "mixed"),
}


def test_classes_of_pages(spark):
    rows = [(i, f"http://h/{i}", html) for i, (html, _) in PAGES.items()]
    got = {r["page_id"]: r["class"] for r in query(spark, "page_classes", pages=(rows, "page_id long, url string, html string"))}
    assert got == {i: want for i, (_, want) in PAGES.items()}


def test_chunks_end_at_scenes_paragraphs_and_sentences():
    text = "a" * 90 + "b" * 110
    assert splitting.scene_chunks(text, [90], 100, 20) == ["a" * 90, "b" * 100, "b" * 30]
    assert splitting.scene_chunks("a" * 85 + ". " + "c" * 60, [], 100, 20) == ["a" * 85 + ".", "a" * 5 + ". " + "c" * 60]
    assert splitting.scene_chunks("", [], 100, 20) == [] and splitting.scene_chunks("x", [5], 100, 20) == ["x"]
    assert splitting.scene_chunks("d" * 84 + "\n\n" + "e" * 30, [], 100, 20)[0] == "d" * 84


def test_mixed_and_advanced():
    talk, prose = '"I will not go there today, whatever they say." ', "The rain came down on the old roofs of the town. "
    assert splitting.mixed((talk + prose) * 2) and not splitting.mixed(prose * 4) and not splitting.mixed(talk + prose)
    assert splitting.needs_advanced('"Go," John said. "No," Mary replied. They went on along the road as it got dark and cold around them both.')
    assert not splitting.needs_advanced(prose * 4) and not splitting.needs_advanced(talk)
    assert splitting.needs_advanced(talk + prose * 6)
