"""Script form and pages: kinds of lines, names on lines of their own, mixed paragraphs, classes of pages, chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import splitting
from folio.functions.fragments import any_of, hits
from folio.operators import text  # noqa: F401  its views are named here
from folio.operators.text import CHUNK, SHARED, SPACE
from folio.plans.sql import Catalogue, view
from folio.sources.tables import load

C = Catalogue()

#: Verbs and things of the stage, looked for in lines without marks of dialogue, as substrings.
STAGE_WORDS = [
    "enter",
    "exit",
    "exeunt",
    "fight",
    "die",
    "aside",
    "apart",
    "beats",
    "strikes",
    "draws",
    "sheathes",
    "kneels",
    "rises",
    "falls",
    "whispers",
    "shouts",
    "cries",
    "laughs",
    "weeps",
    "runs",
    "walks",
    "music",
    "sound",
    "lights",
    "curtain",
]
#: Marks of structure, as substrings of any line.
STAGE_MARKS = ["scene", "act", "prologue", "epilogue", "finis", "the end"]
_entry = "(?i)^(enter +.+|(exit|exeunt)( +.+)?|.+ +(fights?|dies?|aside|apart)|(act|scene) +[ivx0-9]+.*)$$"
_business = "(?i)^[a-z][a-z ]* +(beats?|strikes?|draws?|sheathes?|kneels?|rises?|falls?|whispers?|shouts?|cries?|laughs?|weeps?)( +[a-z].*| *)$$"
_place = "(?i)^[a-z]+[.] *[a-z][a-z ]*(place|street|room|hall|castle|palace|garden|field|forest|court|chamber)[.]$$"


def stage(line: str) -> str:
    """Is the line a stage direction?"""
    patterns = " or ".join(f"$rlike({line}, '{p}')" for p in (_entry, _business, _place))
    plain = f"(not {any_of(line, [chr(34), chr(39), ':', '?', '!'])} and {any_of(f'lower({line})', STAGE_WORDS)})"
    return f"({line} <> '' and ({patterns} or {plain} or {any_of(f'lower({line})', STAGE_MARKS)}))"


def script(line: str) -> str:
    """Does the line start with a name and a colon?"""
    part = "[a-zA-Z0-9_ .''-]"
    return f"($rlike({line}, '^[-– ]? *[A-Z]{part}{part}+:') and $pos({line}, ':') <= 53)"


def lone_name(line: str) -> str:
    """Is the line a name and nothing else? To be asked of lines that are no stage directions."""
    return f"(length({line}) between 2 and 50 and not $rlike({line}, '(?i)^(chorus)$$') and ($rlike({line}, '^[A-Z][A-Z0-9_ .''-]+$$') or $rlike({line}, '^[A-Z][a-z]+( [A-Z][a-z]+)*$$')))"


#: Conversations as plays: an entry, then for every turn a name on a line of its own, or the script line, and the text.
view(
    "play_lines",
    """
select conv_id, cast(turn * 4 as bigint) as line_no, 'Enter ' || upper(role) as line from {utterances} where turn % 3 = 0
union all select conv_id, cast(turn * 4 + 1 as bigint), upper(role) from {utterances} where turn % 4 <> 0
union all select conv_id, cast(turn * 4 + 2 as bigint), trim(translate(split_part(text, '.', 1), '\n', ' ')) from {utterances}
union all select conv_id, cast(turn * 4 + 3 as bigint), trim(translate(split_part(text, '.', 2), '\n', ' ')) from {utterances}""",
)
view(
    "kinds",
    f"""
select conv_id, line_no, line, case when is_stage then 'stage' when is_script then 'script' when {lone_name("line")} then 'name' else 'other' end as kind
from (select conv_id, line_no, line, {stage("line")} as is_stage, {script("line")} as is_script from {{play_lines}} where line <> '') t""",
)
C.add("line_kinds", "select conv_id, line_no, kind from {kinds}", doc="Stage directions, script lines, names on lines of their own, and others.")
view(
    "islands",
    """
select *, max(case when kind = 'name' then 1 else 0 end) over (partition by conv_id, island) as named
from (select *, sum(case when kind <> 'other' then 1 else 0 end) over (partition by conv_id order by line_no) as island from {kinds}) t""",
)
_merged = """
select conv_id, min(line_no) as line_no, count(*) as lines, max(case when kind = 'name' then line end) as name, JOINED as text
from {islands} group by conv_id, case when named = 1 then -island - 1 else line_no end"""
C.add(
    "script_merge",
    _merged.replace("JOINED", "array_join(transform(array_sort(collect_list(struct(line_no, line, kind))), x -> x.line || case when x.kind = 'name' and count(*) > 1 then ':' else '' end), ' ')"),
    _merged.replace("JOINED", "string_agg(line || case when kind = 'name' and more then ':' else '' end, ' ' order by line_no)").replace("from {islands}", "from (select *, count(*) over (partition by conv_id, island) > 1 as more from {islands}) t"),
    doc="A name on a line of its own takes the lines up to the next name, stage direction or script line; blank lines go.",
)
view(
    "paragraphs",
    """
select conv_id, floor(line_no / 4e0) as paragraph, line_no, line, kind, max(case when kind in ('stage', 'script') then 1 else 0 end) over (partition by conv_id, floor(line_no / 4e0)) as by_line from {kinds}""",
)
C.add(
    "paragraph_dispatch",
    f"""
with i as (select *, sum(case when kind in ('stage', 'script') then 1 else 0 end) over (partition by conv_id, paragraph order by line_no) as island from {{paragraphs}}),
l as (select conv_id, paragraph, min(line_no) as line_no, count(*) as lines, cast(sum(length(line)) as bigint) as chars, max(kind) as kind from i where by_line = 1
  group by conv_id, paragraph, island, case when kind in ('stage', 'script') then 1 else 0 end)
select conv_id, cast(paragraph as bigint) as paragraph, line_no, lines, chars, case when kind in ('stage', 'script') then kind else 'joined' end as kind from l
union all select conv_id, cast(paragraph as bigint), min(line_no), count(*), cast(sum(length(regexp_replace(line, '{SPACE}', ' '$g))) as bigint), 'narrative' from {{paragraphs}} where by_line = 0 group by conv_id, paragraph""",
    doc="Paragraphs with a script line or a stage direction go line by line, with other lines joined; the rest go as a whole.",
)

#: Marks of the classes of pages.
PG = [
    "project gutenberg",
    "gutenberg ebook",
    "release date:",
    "title:",
    "author:",
    "language:",
    "credits:",
    "most recently updated:",
    "produced by",
    "utf-8",
    "encoding",
    "start of the project gutenberg ebook",
    "end of the project gutenberg ebook",
]
WEB = [
    "[complete]",
    "] author:",
    "chapters.",
    "hits=",
    "views:",
    "bookmarks:",
    "web novel",
    "light novel",
    "tls123",
    "ways of survival",
    "translator note",
    "tl note",
    "t/n:",
    "translated by",
    "next chapter",
    "previous chapter",
    "bookmark this",
    "add to library",
]
CRITICS = [
    "george saintsbury",
    "saintsbury",
    "literary critic",
    "critic",
    "literary analysis",
    "critical analysis",
    "jane austen",
    "miss austen",
    "the author",
    "mansfield park",
    "sense and sensibility",
    "emma",
    "other novels",
    "other works",
    "compared to",
    "in my opinion",
    "it seems to me",
    "the reader",
    "readers",
    "scholars",
    "scholarly",
]
PUBLISHERS = ["george allen", "charing cross road", "ruskin house", "publisher", "first published", "originally published", "printed in", "copyright", "all rights reserved"]
_navigation = r"chapter +[0-9]+:[^\n]* +[0-9]+[.]|(chapter|epilogue) +[0-9]+ *[–-][^\n]*[ivx]+ +[0-9]+|chapter +[0-9]+[^\n]*epilogue[^\n]*[0-9]+[.]"
view(
    "pages_of_lines",
    """
select page_id, count(*) as n, sum(length(line)) + count(*) - 1 as size, sum(case when chapter_like then 1 else 0 end) * 1e0 / count(*) as chapter_like, sum(case when kind = 'metadata' then 1 else 0 end) * 1e0 / count(*) as metadata,
  sum(case when kind = 'chapter' then 1 else 0 end) * 1e0 / count(*) as chapters, sum(case when kind = 'talk' then 1 else 0 end) * 1e0 / count(*) as talk, sum(case when kind = 'prose' then 1 else 0 end) * 1e0 / count(*) as prose,
  $any(navigation) as navigation from {classed_lines} group by page_id""",
)
view(
    "classed_lines",
    f"""
select page_id, $rlike(low, '{_navigation}') or $rlike(low, '^[0-9]+[.] *$$') as navigation, $rlike(low, 'chapter +[0-9]+|epilogue +[0-9]+|prologue|[0-9]+[.] *chapter') as chapter_like, line,
  case when $rlike(low, '^(title:|author:|release +date:|language:|credits:|chapter +[0-9]+ *$$|[0-9]+ *$$)') then 'metadata'
    when $rlike(line, '(?i)^chapter +[0-9]+.*[ivx]+ *$$') or $rlike(line, '^Chapter +[0-9]+:') or (length(line) < 100 and contains(line, 'Chapter') and {any_of("line", ["–", "—", ":"])}) or $rlike(line, '^[0-9]+[.] *$$') then 'chapter'
    when {any_of("line", ['"', "“", "”", "―", "—", "'"])} then 'talk' when length(line) > 50 and contains(line, '.') then 'prose' else 'other' end as kind
from (select page_id, line, lower(line) as low from {{page_lines}}) t""",
)
view(
    "page_marks",
    """
select page_id, trim(regexp_replace(lower(html), '<[^>]*>', '\n'$g)) as low from {pages}""",
)
C.add(
    "page_classes",
    f"""
select m.page_id, case when n is null then 'empty' when {any_of("low", PG)} then 'pg_metadata' when navigation or (n >= 2 and chapter_like > 0.5e0) then 'chapter_nav'
    when {any_of("low", WEB)} then case when {any_of("low", ["author note", "thanks for reading", "please rate"])} then 'author_notes' when {any_of("low", ["next chapter", "previous chapter", "bookmark"])} then 'chapter_nav'
      when {any_of("low", ["click here", "read more", "add to library"])} then 'platform_ui' else 'web_metadata' end
    when {hits("low", CRITICS)} >= 2 or contains(low, 'saintsbury') then 'preface' when {any_of("low", PUBLISHERS)} then 'metadata' when metadata > 0.4e0 then 'metadata' when chapters > 0.6e0 then 'toc'
    when chapters > 0.3e0 and talk < 0.1e0 then 'mixed_toc' when talk > 0.2e0 or prose > 0.4e0 then case when metadata > 0.2e0 then 'mixed' else 'story' end
    when {any_of("low", ["epilogue", "prologue", "chapter", "part", "section"])} and size < 500 then 'chapter_header' when {any_of("low", ["preface", "foreword", "introduction"])} and size > 200 then 'preface'
    when size < 200 then 'metadata' else 'mixed' end as class
from {{page_marks}} m left join {{pages_of_lines}} p on m.page_id = p.page_id""",
    doc="Thirteen classes by rules in their order: marks of e-texts and web novels, critics, publishers, then shares of lines.",
)

C.add(
    "chunk_windows",
    f"""
select doc_id, cast(k as bigint) as window_index, cast(size(split(trim(substring(text, k * {CHUNK - SHARED} + 1, {CHUNK})), '\n')) as bigint) as task_lines, 0 as context_lines, false as has_context
from {{documents}} lateral view explode(sequence(0, greatest(0, cast(ceil((length(text) - {CHUNK}) / {CHUNK - SHARED}e0) as int)))) as k""",
    f"""
select doc_id, cast(k as bigint) as window_index, cast(len(string_split(trim(substring(text, k * {CHUNK - SHARED} + 1, {CHUNK})), '\n')) as bigint) as task_lines, 0 as context_lines, false as has_context
from (select doc_id, text, unnest(range(0, greatest(0, cast(ceil((length(text) - {CHUNK}) / {CHUNK - SHARED}e0) as int)) + 1)) as k from {{documents}}) t""",
    doc="Chunks as windows without context.",
)


def scene_chunks(documents: DataFrame, breaks: DataFrame) -> DataFrame:
    """doc_id, chunk_index, chunk: chunks that end at breaks of scenes (doc_id, kept), else at paragraphs or sentences."""

    @F.pandas_udf("array<string>")
    def _chunks(texts: pd.Series, breaks: pd.Series) -> pd.Series:
        return pd.Series([splitting.scene_chunks(t or "", [] if b is None else list(b), CHUNK, SHARED) for t, b in zip(texts, breaks)])

    return documents.join(breaks, "doc_id", "left").select("doc_id", F.posexplode(_chunks("text", "kept")).alias("chunk_index", "chunk"))


def scene_chunks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scene_chunks(documents, text.thinned(load(spark, sf_dir, "breaks")))


def split_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id, mixed, advanced: does a segment hold dialogue and narrative, does it need more than sentences?"""

    @F.pandas_udf("struct<mixed: boolean, advanced: boolean>")
    def _predicates(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"mixed": [splitting.mixed(t or "") for t in texts], "advanced": [splitting.needs_advanced(t or "") for t in texts]})

    return load(spark, sf_dir, "segments").select("segment_id", _predicates("text").alias("p")).select("segment_id", "p.mixed", "p.advanced")


QUERIES, ORACLES = C.queries | {"scene_chunks": scene_chunks_query, "split_predicates": split_predicates}, C.oracles
