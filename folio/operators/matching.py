"""Names that are like other names: candidates by equal keys, so that only pairs that may pass are scored.

What two texts of lengths l and m must reach tells how many letters they share in order at least, and in how many edits
they differ at most. So they meet under a stretch of letters that is left of both when the others are put out, with both
lengths; a pair that meets under one does share them, and no other pair is made. Where a text has over MOST such
stretches, the pair meets under a segment: of k + 1 even segments of the one at least one is unchanged in the other after
k edits, at most k places away.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import fuzzy
from folio.plans.sql import full_text
from folio.sources.tables import load

#: What the ratio of a name must exceed, in hundredths.
ABOVE = 80
#: Keys of a text for one length of its partners, at most.
MOST = 3000
#: Keys that a task hands over at once.
KEYS = 1 << 16

#: Of a text's length: (length of a partner, letters shared at least, edits at most) for all lengths that a partner may have.
Rule = Callable[[int], list[tuple[int, int, int]]]


def ratio_over(above: int) -> Rule:
    """Texts with a ratio over ``above``: an edit puts in or leaves out a letter."""

    def run(n: int) -> list[tuple[int, int, int]]:
        lengths = range(max(1, math.ceil(n * above / (200 - above))), n * (200 - above) // above + 1)
        most = [(m, math.ceil((100 - above) * (n + m) / 100) - 1) for m in lengths]
        return [(m, (n + m - k + 1) // 2, k) for m, k in most if k >= abs(n - m)]

    return run


def distance_under(part: int) -> Rule:
    """Texts with an edit distance under the ``part``-th of the longer one's length."""

    def run(n: int) -> list[tuple[int, int, int]]:
        most = [(m, (max(n, m) - 1) // part) for m in range(max(1, n - n // part), n * part // (part - 1) + 2)]
        return [(m, max(n, m) - d, d) for m, d in most if d >= abs(n - m)]

    return run


def _segments(n: int, k: int) -> list[tuple[int, int]]:
    return [(i * n // (k + 1), (i + 1) * n // (k + 1)) for i in range(k + 1)]


def keys(text: str, rule: Rule, first: bool) -> Iterator[str]:
    """Keys of a text, as the ``first`` of a pair or as the other; two texts that the rule lets pass share one."""
    own = len(text)
    for other, shared, edits in rule(own):
        n, m = (own, other) if first else (other, own)
        if math.comb(max(n, m), shared) <= MOST:
            yield from {f"{n},{m},{''.join(x)}" for x in itertools.combinations(text, shared)}
        elif first:
            yield from (f"{n},{m},{i},{text[a:b]}" for i, (a, b) in enumerate(_segments(n, edits)))
        else:
            for i, (a, b) in enumerate(_segments(n, edits)):
                yield from {f"{n},{m},{i},{text[j : j + b - a]}" for j in range(max(0, a - edits), min(m - (b - a), a + edits) + 1)}


def _keyed(rule: Rule, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = ((name, key) for name, form in zip(*(c.to_pylist() for c in b.columns)) for key in keys(form, rule, first))
            while part := list(itertools.islice(rows, KEYS)):
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*part)], ["name", "key"])

    return run


def halves(rule: Rule) -> tuple[Rule, Rule]:
    """The rule for partners that are as long or longer, and as long or shorter."""
    return (lambda n: [x for x in rule(n) if x[0] >= n]), (lambda n: [x for x in rule(n) if x[0] <= n])


def _meeting(left: DataFrame, right: DataFrame, rule: Rule, other: Rule) -> DataFrame:
    """Spark takes the keys for as many bytes as the names, of which each has hundreds; the hint keeps it from sending them to the driver for a broadcast."""
    spark = left.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # small tables have many keys
    keyed = lambda df, x, rule, first: df.select(x, "form").repartition(parts).mapInArrow(_keyed(rule, first), "name string, key string")
    return keyed(left, "name", rule, True).join(keyed(right, "known", other, False).withColumnRenamed("name", "known").hint("merge"), "key").select("name", "known")


def meeting(left: DataFrame, right: DataFrame, rule: Rule) -> DataFrame:
    """(name, known): pairs of (name, form) and (known, form) whose forms share a key, some of them repeatedly."""
    return _meeting(left, right, rule, rule)


def meeting_each_other(names: DataFrame, rule: Rule) -> DataFrame:
    """(name, known): pairs of (name, form) whose forms share a key, the first by name first, some of them repeatedly.

    The shorter one is the first of a pair, which leaves half of the keys.
    """
    pairs = _meeting(names, names.withColumnRenamed("name", "known"), *halves(rule)).where("name <> known")
    return pairs.select(F.least("name", "known").alias("name"), F.greatest("name", "known").alias("known"))


def _sorted_words(name: F.Column) -> F.Column:
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"(?U)\w+"), F.lit(0)))), " ")


def _formed(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("name").alias(name)).distinct().withColumn("form", _sorted_words(F.col(name))).where("form <> ''")


def _sharing_a_word(names: DataFrame, known: DataFrame) -> DataFrame:
    words = lambda df, x: df.select(x, F.explode(F.split("form", " ")).alias("key"))
    return words(names, "name").join(words(known, "known"), "key").select("name", "known")


def candidates(left: DataFrame, right: DataFrame, above: int = ABOVE) -> DataFrame:
    """(name, known): all pairs that may have a token set ratio over ``above``, and some others.

    They share a word, or the sorted words of both are alike as texts.
    """
    names, known = _formed(left, "name"), _formed(right, "known")
    return _sharing_a_word(names, known).unionByName(meeting(names, known, ratio_over(above))).distinct()


def candidates_among(names: DataFrame, above: int = ABOVE) -> DataFrame:
    """The same for the names of one table, without pairs of a name with itself."""
    names = _formed(names, "name")
    shared = _sharing_a_word(names, names.withColumnRenamed("name", "known")).where("name < known")
    pairs = shared.unionByName(meeting_each_other(names, ratio_over(above))).distinct()
    return pairs.select(F.inline(F.array(F.struct("name", "known"), F.struct(F.col("known").alias("name"), F.col("name").alias("known")))))


def best_match(left: DataFrame, right: DataFrame | None = None, above: int = ABOVE, score: Callable = fuzzy.token_set_ratio) -> DataFrame:
    """The best of ``right``'s names (or its own) for each of ``left``'s, another one and strictly over a threshold; of equal ones the first by name."""
    scored = fuzzy.scorer(score).asNondeterministic()  # or the filter would score every pair again
    met = candidates_among(left, above) if right is None else candidates(left, right, above)
    pairs = met.where("name <> known").withColumn("score", scored("name", "known")).where(F.col("score") > above)
    best = Window.partitionBy("name").orderBy(F.desc("score"), "known")
    return pairs.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a capital in the lines, as names."""
    return load(spark, sf_dir, "utterances").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("name"))


def fuzzy_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the lines that are like other words of them."""
    return best_match(words(spark, sf_dir))


def fuzzy_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words whose edit distance is under a fifth of the longer one's length, each pair once."""
    found = words(spark, sf_dir).distinct()
    pairs = meeting_each_other(found.withColumn("form", F.lower("name")), distance_under(5)).distinct().withColumn("distance", F.levenshtein(F.lower("name"), F.lower("known")).cast("long"))
    ratio = F.round(1 - F.col("distance") / F.greatest(F.length("name"), F.length("known")), 9)
    return pairs.select("name", F.col("known").alias("other"), "distance", ratio.alias("ratio")).where("ratio > 0.8")


def name_contains(lines: DataFrame, names: DataFrame) -> DataFrame:
    """conv_id, turn, name, score: the best name that a line of (conv_id, turn, text) holds, as it is or in other letters' case.

    A name that a line holds begins with a stretch of three letters of the line (one, for shorter names).
    """
    low = F.lower("text")
    grams = lambda n: F.expr(f"transform(sequence(1, greatest(1, length(low))), i -> substring(low, i, {n}))")
    held = lines.select("conv_id", "turn", low.alias("low")).select("conv_id", "turn", F.explode(F.array_distinct(F.concat(grams(3), grams(1)))).alias("gram"))
    known = names.select("name").where("name <> ''").distinct()
    starts = known.select("name", F.substring(F.lower("name"), 1, 3).alias("gram")).withColumn("gram", F.when(F.length("name") < 3, F.substring("gram", 1, 1)).otherwise(F.col("gram")))
    pairs = held.join(starts, "gram").select("conv_id", "turn", "name")
    scored = pairs.join(lines.select("conv_id", "turn", "text"), ["conv_id", "turn"]).where(F.contains(low, F.lower("name")))
    scored = scored.select("conv_id", "turn", "name", F.when(F.contains("text", F.col("name")), 0.85).otherwise(0.7).alias("score"))
    best = Window.partitionBy("conv_id", "turn").orderBy(F.desc("score"), "name")
    return scored.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def name_contains_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_contains(load(spark, sf_dir, "utterances"), load(spark, sf_dir, "names"))


QUERIES = {"fuzzy_top1": fuzzy_top1, "fuzzy_levenshtein": fuzzy_levenshtein, "name_contains_theta": name_contains_theta}
_words = """select distinct name from (select unnest(regexp_extract_all(text, '[A-Z][a-z]+')) as name from {utterances}) w"""
#: Written apart: all pairs, which a table of any size forbids.
ORACLES = {
    "fuzzy_levenshtein": full_text(
        f"""
with w as ({_words})
select a.name, b.name as other, levenshtein(lower(a.name), lower(b.name)) as distance, round(1e0 - levenshtein(lower(a.name), lower(b.name)) * 1e0 / greatest(length(a.name), length(b.name)), 9) as ratio
from w a join w b on a.name < b.name where round(1e0 - levenshtein(lower(a.name), lower(b.name)) * 1e0 / greatest(length(a.name), length(b.name)), 9) > 0.8e0""",
        1,
    )[0],
    "name_contains_theta": full_text(
        """
select conv_id, turn, name, score from (select *, row_number() over (partition by conv_id, turn order by score desc, name) as place from (
  select u.conv_id, u.turn, n.name, case when contains(u.text, n.name) then 0.85e0 else 0.7e0 end as score from {utterances} u join {names} n on contains(lower(u.text), lower(n.name))) t) r where place = 1""",
        1,
    )[0],
}
