"""Raw text: statistics, filters, classifiers, structure, point of view, lines, windows and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.fragments import any_of, clamp, hits, n_words, share, word
from folio.plans.sql import Catalogue, view
from folio.sources.tables import load

C = Catalogue()

#: Marks of public-domain e-texts, any of which counts in the first 2000 characters.
GUTENBERG = [
    "PROJECT GUTENBERG EBOOK",
    "Release date:",
    "Author:",
    "Title:",
    "Language:",
    "Credits:",
    "This file was produced",
    "http://www.pgdp.net",
    "Most recently updated:",
    "*** START OF THE PROJECT GUTENBERG EBOOK",
    "*** END OF THE PROJECT GUTENBERG EBOOK",
]
#: Marks of web novels, three of which count in the first 5000 characters. The first can never
#: match, as the text is lower-cased.
WEB_NOVEL = [
    "Author:",
    "tls123",
    "ways of survival",
    "complete]",
    "kim dokja",
    "yoo sangah",
    "jung heewon",
    "lee hyunsung",
    "chapter ",
    "prologue",
    "[complete]",
    "web novel",
    "translator note",
    "tl note",
    "t/n:",
    "translated by",
    "] author:",
    "chapters.",
    "hits=",
    "views:",
    "bookmarks:",
    "ruined world",
    "apocalypse",
    "system",
    "status window",
    "i have been",
    "i scrolled down",
    "i looked again",
    "dok-",
    "sang-",
    "hee-",
    "hyun-",
]

SPACE = "[ \t\n\r]+"


def count_of(text: str, pattern: str) -> str:
    return f"$size($findall({text}, '{pattern}'$group0))"


def gutenberg(text: str) -> str:
    return any_of(f"upper(substring({text}, 1, 2000))", [m.upper() for m in GUTENBERG])


def web_novel(text: str) -> str:
    return f"{hits(f'lower(substring({text}, 1, 5000))', WEB_NOVEL)} >= 3"


C.add("gutenberg_webnovel_flags", f"select doc_id, {gutenberg('text')} as gutenberg, {web_novel('text')} as web_novel from {{documents}}")

view(
    "doc_lines",
    "select doc_id, count(*) as n_lines, cast(sum(case when trim(line) <> '' then 1 else 0 end) as bigint) as filled from {lines} group by doc_id",
)
_pieces = f"$split(regexp_replace(text, '([.!?]){SPACE}', '$ref1' || chr(1)$g), chr(1))"
view("sentence_lists", f"select doc_id, {_pieces} as sentences from {{documents}}")
C.add(
    "doc_text_stats",
    f"""
select doc_id, cast(length(text) as bigint) as chars, cast(n as bigint) as words, cast($size($split(text, '\n')) as bigint) as lines,
  cast($size($resplit(text, '\n[ \t]*\n')) as bigint) as paragraphs, cast($size({_pieces}) as bigint) as sentences,
  round({share(f"length(regexp_replace(text, '{SPACE}', ''$g))", "n")}, 9) as avg_word_length,
  {share(count_of("lower(text)", "[^a-z](the|and|is|in|to|of|a|that|it|with|for|as|was|on|are|you)[^a-z]"), "n")} > 0.1e0 as english
from (select doc_id, text, {n_words("text")} as n from {{documents}}) t""",
    doc="One row per row, repeated ids too, in one pass over the text; nulls for a null text.",
)
C.add(
    "basic_line_filter",
    "select doc_id, array_join(filter(transform(split(text, '\n'), l -> trim(l)), l -> length(l) >= 3), '\n') as text from {documents}",
    "select doc_id, array_to_string(list_filter(list_transform(string_split(text, '\n'), lambda l: trim(l)), lambda l: length(l) >= 3), '\n') as text from {documents}",
)
C.add("line_number", "select doc_id, line_no, cast(length(line) as bigint) as size from {lines}")
C.add(
    "paragraph_sentence_split",
    "select doc_id, cast(pos + 1 as bigint) as sentence_no, sentence from (select doc_id, posexplode(sentences) as (pos, sentence) from {sentence_lists}) t where trim(sentence) <> ''",
    "select * from (select doc_id, cast(unnest(range(1, len(sentences) + 1)) as bigint) as sentence_no, unnest(sentences) as sentence from {sentence_lists}) t where trim(sentence) <> ''",
)
view(
    "sentences",
    "select doc_id, cast(pos + 1 as bigint) as sentence_no, sentence from (select doc_id, posexplode(sentences) as (pos, sentence) from {sentence_lists}) t",
    "select doc_id, cast(unnest(range(1, len(sentences) + 1)) as bigint) as sentence_no, unnest(sentences) as sentence from {sentence_lists}",
)

#: What lowers the score of a text as story, much or a little, and what raises it.
MUCH_LESS = [
    "project gutenberg",
    "gutenberg ebook",
    "release date:",
    "title:",
    "author:",
    "language:",
    "credits:",
    "george saintsbury",
    "saintsbury",
    "literary critic",
    "jane austen",
    "miss austen",
    "the author",
    "mansfield park",
    "sense and sensibility",
    "emma",
    "other novels",
    "first published",
    "printed in",
    "copyright",
    "george allen",
]
LITTLE_LESS = ["chapter", "prologue", "epilogue", "preface", "foreword", "table of contents", "index", "appendix", "bibliography"]
VERBS = [
    "said|replied|asked|whispered|shouted|muttered|exclaimed",
    "walked|ran|looked|turned|smiled|frowned|nodded",
    "thought|wondered|realized|remembered|decided",
]
_talk = any_of("t", ['"', "'", "—", "–"])
_verbs = " + ".join(f"case when $rlike(low, '{word(v)}') then 1 else 0 end" for v in VERBS)
C.add(
    "story_score",
    f"""
select doc_id, case when n < 10 then 0e0 else {
        clamp(f'''round(0.5e0 - 0.4e0 * {hits("low", MUCH_LESS)} - case when n < 200 then 0.2e0 * {hits("low", LITTLE_LESS)} else 0e0 end
    + case when talk then 0.3e0 else 0e0 end + least(0.2e0, verbs * 0.1e0) + case when talk and verbs > 0 then 0.2e0 else 0e0 end
    + case when n > 100 then 0.1e0 else 0e0 end + case when n > 500 then 0.1e0 else 0e0 end
    + case when $rlike(t, '(?s)[^.][^.][^.][^.][^.][^.][.].*[^.][^.][^.][^.][^.][^.]') then 0.1e0 else 0e0 end - case when contains(t, ':') and n < 100 then 0.2e0 else 0e0 end
    - case when n < 100 and length(regexp_replace(t, '[^A-Z]', ''$g)) * 1e0 / n > 0.5e0 then 0.2e0 else 0e0 end, 6)''')
    } end as score
from (select doc_id, t, low, n, {_talk} as talk, {_verbs} as verbs from (select doc_id, t, lower(t) as low, length(t) as n from (select doc_id, trim(text) as t from {{documents}}) x) a) b""",
    doc="Two sentences count if six characters that are no full stops come before a full stop and after it.",
)

C.add(
    "html_to_text",
    f"""
select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' '$g), '<[^>]*>', ' '$g), '{SPACE}', ' '$g)) as text from {{pages}}""",
)
view(
    "page_lines",
    """
select page_id, cast(pos + 1 as bigint) as line_no, trim(line) as line from (select page_id, posexplode(split(regexp_replace(html, '<[^>]*>', '\n'), '\n')) as (pos, line) from {pages}) t where trim(line) <> ''""",
    """
select page_id, line_no, trim(line) as line from (select page_id, cast(unnest(range(1, len(string_split(h, '\n')) + 1)) as bigint) as line_no, unnest(string_split(h, '\n')) as line
  from (select page_id, regexp_replace(html, '<[^>]*>', '\n', 'g') as h from {pages}) a) t where trim(line) <> ''""",
)
view(
    "page_shares",
    f"""
select page_id, count(*) as n, sum(case when is_meta then 1 else 0 end) * 1e0 / count(*) as meta, sum(case when is_chapter then 1 else 0 end) * 1e0 / count(*) as chapters,
  sum(case when is_talk then 1 else 0 end) * 1e0 / count(*) as talk, sum(case when is_prose then 1 else 0 end) * 1e0 / count(*) as prose, $any(is_legal) as legal
from (select page_id, is_meta, not is_meta and chapter as is_chapter, not is_meta and not chapter and talk as is_talk,
    not is_meta and not chapter and not talk and length(line) > 50 and contains(line, '.') as is_prose, is_legal
  from (select page_id, line, $rlike(lower(line), '^(title:|author:|release +date:|language:|credits:|chapter +[0-9]+ *$$|[0-9]+ *$$)') as is_meta,
      $rlike(line, '^[Cc]hapter +[0-9]+') or $rlike(line, '^[0-9]+[.] *$$') as chapter, {any_of("line", ['"', "―", "—", "'"])} as talk,
      {any_of("lower(line)", ["copyright", "all rights reserved", "first published", "publisher"])} as is_legal from {{page_lines}}) a) b group by page_id""",
)
PAGE_CLASS = """case when legal then 'metadata' when chapters > 0.5e0 then 'toc' when meta > 0.5e0 then 'metadata' when n <= 3 and chapters > 0e0 then 'chapter_header'
  when talk + prose > 0.6e0 then 'story' when talk + prose > 0.3e0 then 'mixed' else 'other' end"""
C.add("page_line_classify", f"select page_id, n as lines, round(talk, 9) as talk, round(prose, 9) as prose, {PAGE_CLASS} as content_type from {{page_shares}}")
C.add(
    "page_filter",
    f"""
with c as (select p.page_id, p.host as book, {PAGE_CLASS} as content_type from {{page_shares}} s join (select page_id, regexp_extract(url, '://([^/?#]*)', 1) as host from {{pages}}) p on s.page_id = p.page_id),
s as (select *, coalesce(max(case when content_type in ('story', 'mixed') then 1 else 0 end) over (partition by book order by page_id), 0) = 1 as started,
  row_number() over (partition by book order by page_id) - row_number() over (partition by book, content_type order by page_id) as island from c),
r as (select *, row_number() over (partition by book, content_type, island order by page_id) as run from s)
select page_id, content_type, started, cast(run as bigint) as run, case content_type when 'metadata' then false when 'toc' then started and run <= 2 else true end as kept from r""",
    doc="Tables of contents go before the story starts, and from the third in a row on; the pages of a host are a book.",
)

#: Marks of prefaces.
PREFACE = ["preface", "introduction", "foreword", "editor's note", "literary", "critics", "scholars", "this edition", "this volume", "first published", "originally written"]
_starts = "(?i)^( *chapter +(i|1) *$$| *(i|1)[.] *$$|[A-Z][a-z]+ was |the [a-z]+ was |once upon a time|call me ishmael|it was the best of times)"
_prose = f"length(trim(line)) > 50 and contains(line, '.') and $rlike(trim(line), '^[A-Z]') and not $rlike(line, '(?i)^(title|author|release date|language|credits):')"
view(
    "story_edges",
    f"""
select doc_id, coalesce(min(case when story and line_no > marker and line_no <= marker + 500 then line_no end), marker + 1) as first_line,
  coalesce(max(case when ending and line_no > n_lines - 99 then line_no end) - 1, max(n_lines)) as last_line
from (select l.doc_id, l.line_no, n_lines, coalesce(min(case when contains(upper(line), '*** START OF THE PROJECT GUTENBERG EBOOK') then line_no end) over (partition by l.doc_id), 0) as marker,
    not {any_of("lower(line)", PREFACE)} and ($rlike(trim(line), '{_starts}') or ({_prose})) as story,
    contains(upper(line), '*** END OF THE PROJECT GUTENBERG EBOOK') as ending
  from {{lines}} l join {{doc_lines}} d on l.doc_id = d.doc_id) t group by doc_id, marker""",
)
C.add("story_bounds", "select doc_id, first_line, last_line, last_line - first_line + 1 as lines from {story_edges}")
ARTEFACT = "(?i)^($lb(illustration)|copyright|publisher|printed)"
C.add(
    "story_lines",
    f"""
select l.doc_id, l.line_no, trim(l.line) as line from {{lines}} l join {{story_edges}} e on l.doc_id = e.doc_id
where l.line_no between e.first_line and e.last_line and length(trim(l.line)) >= 3 and not $rlike(trim(l.line), '{ARTEFACT}') and not $rlike(trim(l.line), '^[-0-9 ._]*$$')""",
    doc="What the bounds and the filter of artefacts leave.",
)
C.add(
    "aggressive_lines",
    """select doc_id, line_no, trim(line) as line from {lines}
where length(trim(line)) > 20 and $rlike(trim(line), '^[A-Z]') and (contains(line, '.') or contains(line, '"') or contains(line, ','))""",
)
C.add(
    "text_normalize",
    f"""
select doc_id, trim(regexp_replace(translate(text, '“”„「」『』　', repeat('"', 7) || ' '), '{SPACE}', ' '$g)) as text,
  translate(text, '“”‘’', '""' || chr(39) || chr(39)) as quoted from {{documents}}""",
    doc="Marks of other scripts to plain ones, white space to single spaces, over the whole text.",
)


def normalized(documents: DataFrame, max_length: int | None = None) -> DataFrame:
    """``text_normalize`` over these documents; texts are cut only if ``max_length`` is given."""
    found = C["text_normalize"].on(documents=documents)
    return found if max_length is None else found.withColumn("text", F.substring("text", 1, max_length))


#: Pronouns of the first and the third person.
FIRST = "i|my|me|myself|we|us|our|ourselves"
THIRD = "he|she|they|him|her|them|his|hers|their"


def tokens(text: str, words: str) -> str:
    """How many ASCII words of the text are among these; the words are separated by doubling what lies between."""
    return count_of(f"regexp_replace(' ' || lower({text}) || ' ', '[^a-z0-9_]+', '  '$g)", f" ({words}) ")


view(
    "structures",
    f"""
select *, case when first_person > third_person * 1.5e0 then 'first' when third_person > first_person * 1.5e0 then 'third' else 'mixed' end as perspective,
  case when quotes * 3 > dashes * 2 then 'quoted' when dashes > quotes * 6 then 'dashed' else 'mixed' end as dialogue_style,
  least(1e0, chapters / 10e0) as chapter_factor, least(1e0, paragraphs / 100e0) as paragraph_factor
from (select doc_id, length(text) as size, $size($resplit(trim(text), '\n[ \t]*\n')) as paragraphs,
    {share("3 * (length(text) - length(regexp_replace(text, '\"[^\"]*\"', ''$g))) + length(text) - length(regexp_replace(text, '—[^—\n]*', ''$g))", "length(text)")} as density,
    length(text) - length(replace(text, '"', '')) as quotes, length(text) - length(translate(text, '—–', '')) as dashes,
    {count_of("text", "(?i)chapter +([0-9]+|[A-Z]+)")} as chapters, {tokens("text", FIRST)} as first_person, {tokens("text", THIRD)} as third_person
  from {{documents}}) t""",
)
COMPLEXITY = "(density + chapter_factor + paragraph_factor + case when dialogue_style = 'mixed' then 1e0 else 0.5e0 end + case when perspective = 'mixed' then 1e0 else 0.3e0 end) / 5e0"
C.add(
    "structure_profile",
    f"""
select doc_id, cast(size as bigint) as chars, cast(paragraphs as bigint) as paragraphs, round(density, 9) as dialogue_density, round(1e0 - density, 9) as narrative_density, dialogue_style, perspective,
  cast(chapters as bigint) as chapters, case when density > 0.4e0 then 'fiction' else 'nonfiction' end as genre, round({COMPLEXITY}, 9) as complexity from {{structures}}""",
    doc="Quoted characters and quotation marks count three times, as specified, so that a density can exceed 1.",
)

#: The same for points of view.
POV_FIRST = "i|me|my|mine|myself|we|us|our|ours|ourselves"
POV_THIRD = "he|she|they|him|her|them|his|hers|their|theirs|himself|herself|themselves"
view(
    "pov_counts",
    f"select doc_id, {tokens('sample', POV_FIRST)} as a, {tokens('sample', POV_THIRD)} as b from (select doc_id, array_join(slice(split(trim(text), '{SPACE}'), 1, 2000), ' ') as sample from {{documents}}) t",
    f"select doc_id, {tokens('sample', POV_FIRST)} as a, {tokens('sample', POV_THIRD)} as b from (select doc_id, array_to_string(regexp_split_to_array(trim(text), '{SPACE}')[1:2000], ' ') as sample from {{documents}}) t",
)
view(
    "pov",
    """
select doc_id, a, b, case when kind <> 'MIXED' and sure < 0.7e0 then 'MIXED' else kind end as type, greatest(sure, 0.3e0) as confidence
from (select doc_id, a, b, case when a > b * 1.5e0 then 'FIRST_PERSON' when b > a * 1.5e0 then 'THIRD_PERSON' else 'MIXED' end as kind,
    case when a > b * 1.5e0 then least(0.95e0, a * 1e0 / greatest(b, 1) / 1.5e0) when b > a * 1.5e0 then least(0.95e0, b * 1e0 / greatest(a, 1) / 1.5e0) else 0.5e0 end as sure
  from {pov_counts}) t""",
)
C.add("pov_profile", "select doc_id, cast(a as bigint) as first_person, cast(b as bigint) as third_person, type, round(confidence, 9) as confidence from {pov}")
C.add(
    "perspective_shifts",
    f"""
with s as (select doc_id, sentence_no, {tokens("sentence", "i|me|my|myself")} as a, {tokens("sentence", "he|she|they|him|her|them")} as b from {{sentences}}),
p as (select doc_id, sentence_no, case when a > b then 'FIRST_PERSON' else 'THIRD_PERSON' end as pov from s where a <> b),
q as (select *, lag(pov) over (partition by doc_id order by sentence_no) as before from p)
select doc_id, sentence_no, before as from_pov, pov as to_pov from q where pov <> before""",
    doc="Only sentences that lean one way take part, so the one before is the last of these.",
)
C.add(
    "script_likeness",
    """
with f as (select conv_id, $rlike(text, '^([A-Z][A-Z0-9_ ]+|[A-Z][a-z]+( [A-Z][a-z]+)*): *') as script, $rlike(text, '(?i)^(enter |exit |exeunt|(act|scene) +[ivx0-9]+|prologue *$$|epilogue *$$)') as stage from {utterances})
select conv_id, count(*) as lines, cast(sum(case when script then 1 else 0 end) as bigint) as script_lines, cast(sum(case when stage and not script then 1 else 0 end) as bigint) as stage_lines,
  count(*) > 10 and (sum(case when script then 1 else 0 end) > 0.15e0 * count(*) or sum(case when script or stage then 1 else 0 end) > 0.08e0 * count(*)
    or (sum(case when script then 1 else 0 end) >= 5 and sum(case when stage and not script then 1 else 0 end) >= 2)) as script_like from f group by conv_id""",
)

view(
    "placed_lines",
    """
select doc_id, line_no, trim(line) as line, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as pos,
  length(trim(lag(line) over (partition by doc_id order by line_no))) as before, length(trim(lead(line) over (partition by doc_id order by line_no))) as after from {lines}""",
)
BREAK = "(?i)^(chapter +([0-9]+|[a-z]+)|[0-9]+[.]|[*] *[*] *[*]|---+|===+|~~~+|(later|meanwhile|elsewhere|the next day)[.:]?)$$"
view("breaks", f"select doc_id, cast(pos as bigint) as pos, line_no from {{placed_lines}} where line <> '' and ($rlike(line, '{BREAK}') or (length(line) < 30 and before > 100 and after > 100))")
C.add("scene_break_neighbors", "select doc_id, line_no, pos from {breaks}")
def thinned(breaks: DataFrame, apart: int = 100) -> DataFrame:
    """doc_id, kept: a break is kept if over ``apart`` characters from the last one kept (a fold over the sorted array)."""
    far = lambda acc, p: (F.size(acc) == 0) | (p - F.element_at(acc, -1) > apart)
    kept = F.aggregate(F.array_sort(F.collect_set("pos")), F.expr("cast(array() as array<bigint>)"), lambda acc, p: F.when(far(acc, p), F.concat(acc, F.array(p))).otherwise(acc))
    return breaks.groupBy("doc_id").agg(kept.alias("kept"))


def scene_break_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thinned(load(spark, sf_dir, "breaks"))


#: Windows over sentences: of 15 lines, each 4 lines into the one before, with 50 lines of context.
TASK, OVERLAP, CONTEXT = 15, 4, 50
STEP = TASK - OVERLAP
view(
    "numbered_sentences",
    "select doc_id, row_number() over (partition by doc_id order by sentence_no) - 1 as place, count(*) over (partition by doc_id) as n, trim(sentence) as line from {sentences} where trim(sentence) <> ''",
)
view(
    "window_lines",
    f"""
select doc_id, place, n, line, w from (
  select doc_id, place, n, line, floor(place / {STEP}e0) as w from {{numbered_sentences}}
  union all select doc_id, place, n, line, floor(place / {STEP}e0) - 1 as w from {{numbered_sentences}} where place >= {STEP} and place - {STEP} * (floor(place / {STEP}e0) - 1) < {TASK}) t
where w = 0 or w * {STEP} + {OVERLAP} < n""",
)
C.add(
    "sliding_windows",
    f"""
select doc_id, cast(w as bigint) as window_index, min(place) as task_start, max(place) + 1 as task_end, greatest(min(place) - {CONTEXT}, 0) as context_start, count(*) as task_lines,
  cast(sum(length(line)) as bigint) as task_chars, min(place) > 0 as has_context from {{window_lines}} group by doc_id, w""",
    doc="A line goes to the one or two windows that hold it, so there is no range join.",
)
C.add(
    "adaptive_window_size",
    f"""
with base as (select s.doc_id, p.type, density, {COMPLEXITY} as complexity,
    case when density < 0.3e0 then 40 when p.type = 'FIRST_PERSON' then 60 when p.type = 'MIXED' then 75 else 50 end as context0,
    case when density > 0.7e0 then 18 when p.type = 'MIXED' then 12 else 15 end as task0 from {{structures}} s join {{pov}} p on s.doc_id = p.doc_id)
select doc_id, cast({clamp("floor(context0 * case when complexity > 0.8e0 then 1.3e0 else 1e0 end)", "10", "100")} as bigint) as context_size,
  cast({clamp("floor(task0 * case when complexity > 0.8e0 then 0.7e0 else 1e0 end)", "5", "30")} as bigint) as task_size from base""",
)
CHUNK, SHARED = 2500, 500
C.add(
    "char_chunks",
    f"""
select doc_id, cast(k as bigint) as chunk_index, cast(length(substring(text, k * {CHUNK - SHARED} + 1, {CHUNK})) as bigint) as size, md5(substring(text, k * {CHUNK - SHARED} + 1, {CHUNK})) as digest
from {{documents}} lateral view explode(sequence(0, greatest(0, cast(ceil((length(text) - {CHUNK}) / {CHUNK - SHARED}e0) as int)))) as k""",
    f"""
select doc_id, cast(k as bigint) as chunk_index, cast(length(substring(text, k * {CHUNK - SHARED} + 1, {CHUNK})) as bigint) as size, md5(substring(text, k * {CHUNK - SHARED} + 1, {CHUNK})) as digest
from (select doc_id, text, unnest(range(0, greatest(0, cast(ceil((length(text) - {CHUNK}) / {CHUNK - SHARED}e0) as int)) + 1)) as k from {{documents}}) t""",
)

view("starts", "select conv_id, turn, text, $rlike(text, '^[A-Z][A-Z0-9_]*: ') as script from {utterances}")
C.add(
    "script_segments",
    """
with i as (select *, sum(case when script then 1 else 0 end) over (partition by conv_id order by turn) as segment from {starts})
select conv_id, cast(segment as bigint) as segment, min(turn) as first_turn, count(*) as lines, cast(sum(length(text)) as bigint) as chars, max(case when script then split_part(text, ':', 1) end) as speaker from i group by conv_id, segment""",
    doc="A line NAME: starts a segment and others join the one before.",
)
C.add(
    "embedded_dialogue",
    """select conv_id, turn, cast(pos + 1 as bigint) as part_no, part from (select conv_id, turn, posexplode(regexp_extract_all(text, '"[^"]*"|$lb[^$rb]+$rb|[^"$lb]+', 0)) as (pos, part) from {utterances}) t where trim(part) <> ''""",
    """select * from (select conv_id, turn, cast(unnest(range(1, len(p) + 1)) as bigint) as part_no, unnest(p) as part from (select conv_id, turn, regexp_extract_all(text, '"[^"]*"|$lb[^$rb]+$rb|[^"$lb]+') as p from {utterances}) a) t where trim(part) <> ''""",
)
C.add(
    "metadata_segments",
    f"""
select segment_id, $rlike(text, '(?i)^(chapter|title|author|copyright|isbn|page) ?[0-9:]') as by_pattern, cast({hits("lower(text)", ["next chapter", "previous chapter", "bookmark", "click here", "read more", "subscribe", "views:", "rating:"])} as bigint) as ui_marks,
  $rlike(text, '(?i)^(chapter|title|author|copyright|isbn|page) ?[0-9:]') or {hits("lower(text)", ["next chapter", "previous chapter", "bookmark", "click here", "read more", "subscribe", "views:", "rating:"])} >= 2 as metadata from {{segments}}""",
)
QUERIES, ORACLES = C.queries | {"scene_break_thin": scene_break_thin}, C.oracles
