"""URL filters: rules first, then a tree of path templates for each host, in SQL only.

Paths are cut into segments and runs of digits in them become ``#``. Down the tree of a host, to the
last segment, one that has ``#``, or is one of many values and rare among them, becomes the wildcard
``?``; a path holds neither mark. Then, at every level from the top, siblings whose labelled pages are bad
no more and no less often are merged: in the order of their shares, one joins the group before it unless a
test of proportions tells them apart. What is left is a template.

A template's purity is the share of good pages among its labelled ones, smoothed by WEIGHT more pages that
are good as often as those of the same template on all hosts; their share is smoothed in the same way by the
one of the host, this by that of all pages, and that by one half. So evidence reaches templates and hosts
without a label of their own. Templates with a purity under PURE are rejected. Labelled pages are those that
rules decide.

Statistics are made on distinct (host, path with ``#``), counted before they shuffle; large groups are
broadcast to their rows. Each level is written. Below a parent of under MANY_VALUES paths no value can be
rare, and below one without labels or of one template nothing can merge: such branches end at once, so that
long lone paths take no levels.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import pick, stored, with_group

#: Production rules: (verdict, host and path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

MANY_VALUES = 8
RARE = 0.02
Z = 2.0
WEIGHT = 4.0
PURE = 0.3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_case(rules: list[tuple[str, str]], what: int) -> str:
    """The longest rule that fits (of equally long ones the first by text); ``what``: 0 verdict, 1 rule."""
    whens = []
    for rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule[1].partition("/")
        fits = f"(host = {_quoted(host)} or endswith(host, {_quoted('.' + host)})) and startswith(path, {_quoted(slash + path)})"
        whens.append(f"when {fits} then {_quoted(rule[what])}")
    return f"case {' '.join(whens)} end" if whens else "cast(null as string)"


def _judged(rules: list[tuple[str, str]]) -> str:
    """page_id, host, path, rule, what it said, form: the path without outer slashes, runs of digits as ``#``."""
    return f"""
select page_id, host, path, {_rule_case(rules, 1)} as rule, {_rule_case(rules, 0)} as said, regexp_replace(regexp_replace(path, '^/+|/+$', ''), '[0-9]+', '#') as form
from (select page_id, translate(regexp_extract(tail, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) as path
  from (select page_id, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end as tail from {{pages}}) c) p"""


_SEGMENT = "split_part(rest, '/', 1)"
_REST = "case when instr(rest, '/') > 0 then substring(rest, instr(rest, '/') + 1) end"

#: One level: the next segment of ``rest`` goes to ``above``, as it is or as the wildcard.
GENERALISED = f"""
with v as (select host, above, {_SEGMENT} as s, sum(n) as n, count(*) as forms from {{live}} group by host, above, s),
p as (select host, above, count(*) as many, sum(n) as n, sum(forms) as forms from v group by host, above),
g as (select v.host, v.above, s, forms_in < {MANY_VALUES} as few, case when instr(s, '#') > 0 or (many >= {MANY_VALUES} and v.n < {RARE}e0 * total) then '?' else s end as t
  from v join (select host, above, many, n as total, forms as forms_in from p) p on v.host = p.host and v.above = p.above)
select b.host, form, concat(b.above, '/', case when few then array_join(transform(split(rest, '/'), x -> case when instr(x, '#') > 0 then '?' else x end), '/') else t end) as above,
  case when not few then {_REST} end as rest, n, known, bad, open
from {{live}} b join g on b.host = g.host and b.above = g.above and split_part(b.rest, '/', 1) = g.s"""

_share = "(a.bad + k.bad) * 1e0 / (a.known + k.known)"
_alike = f"""a.known > 0 and abs(a.bad * 1e0 / greatest(a.known, 1) - k.bad * 1e0 / k.known)
  <= {Z}e0 * sqrt({_share} * (1e0 - {_share}) * (1e0 / greatest(a.known, 1) + 1e0 / k.known))"""
#: One level: labelled siblings that are alike get one name, ``#`` and a number, which no template has. What is not
#: rare has its share of the parent, so these lists hold as many siblings as RARE and MANY_VALUES allow.
MERGED = f"""
with v as (select host, above, {_SEGMENT} as s, sum(known) as known, sum(bad) as bad, count(*) as leaves from {{live}} group by host, above, s),
p as (select host, above, sum(known) = 0 or sum(leaves) = 1 as alone,
    array_sort(collect_list(case when known > 0 then struct(bad * 1e0 / known as share, -known as size, s, known, bad) end)) as kids from v group by host, above),
f as (select host, above, alone, aggregate(kids, named_struct('no', 0, 'known', 0L, 'bad', 0L, 'names', cast(map() as map<string, int>)),
    (a, k) -> case when {_alike} then named_struct('no', a.no, 'known', a.known + k.known, 'bad', a.bad + k.bad, 'names', map_concat(a.names, map(k.s, a.no)))
      else named_struct('no', a.no + 1, 'known', k.known, 'bad', k.bad, 'names', map_concat(a.names, map(k.s, a.no + 1))) end).names as names from p)
select b.host, template, concat(b.above, '/', case when alone then rest else coalesce(concat('#', names[{_SEGMENT}]), {_SEGMENT}) end) as above,
  case when not alone then {_REST} end as rest, known, bad
from {{live}} b join f on b.host = f.host and b.above = f.above"""


def _smoothed(good: str, known: str, prior: F.Column | float) -> F.Column:
    return (F.col(good) + WEIGHT * prior) / (F.col(known) + WEIGHT)


def _rejected(leaves: DataFrame) -> DataFrame:
    """(host, template, verdict) of leaves (host, template, node, known, bad)."""
    counts = [F.sum("known").alias("known"), F.sum(F.col("known") - F.col("bad")).alias("good"), F.count("*").alias("size")]
    known, good, _ = leaves.agg(*counts).first()
    every = ((good or 0) + WEIGHT / 2) / ((known or 0) + WEIGHT)
    hosts = stored(leaves.groupBy("host").agg(*counts).withColumn("prior", _smoothed("good", "known", F.lit(every))).drop("known", "good"), "hosts")
    own = stored(with_group(leaves, hosts, ["host"]).select("host", "template", "node", "prior"), "own")
    shared = stored(leaves.groupBy("template").agg(*counts), "shared")
    own = with_group(own, shared, "template").withColumn("prior", _smoothed("good", "known", F.col("prior"))).drop("known", "good", "size")
    nodes = leaves.groupBy("host", "node").agg(*counts).drop("size")
    purity = _smoothed("good", "known", F.col("prior"))
    return own.join(nodes, ["host", "node"]).select("host", "template", F.when(purity < PURE, "block").otherwise("allow").alias("verdict"))


def judge(df: DataFrame, rules: list[tuple[str, str]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``df``: page_id, host, path, rule, verdict.

    A null url, or one without ``://``, has empty host and path, and the verdict of that template.
    Repeated and null ids and repeated rows keep a row each; other columns are not read. An empty table
    gives no rows.
    """
    spark = df.sparkSession
    judged = stored(spark.sql(_judged(RULES if rules is None else rules), pages=pick(df, page_id=id_col, url=url_col)), "judged")
    counted = """
select host, form, '' as above, form as rest, count(*) as n, sum(case when said is not null then 1 else 0 end) as known, sum(case when said = 'block' then 1 else 0 end) as bad,
  sum(case when said is null then 1 else 0 end) as open from {judged} group by host, form"""
    forms = _descend(stored(spark.sql(counted, judged=judged), "forms"), GENERALISED, "template")
    forms = stored(forms.select("host", "form", "template", "known", "bad", "open"), "templates")
    leaves = "select host, template, '' as above, substring(template, 2) as rest, sum(known) as known, sum(bad) as bad from {forms} group by host, template"
    leaves = _descend(stored(spark.sql(leaves, forms=forms), "leaves"), MERGED, "node")
    verdicts = _rejected(stored(leaves.select("host", "template", "node", "known", "bad"), "nodes"))
    verdicts = stored(forms.where("open > 0").join(verdicts, ["host", "template"]).select("host", "form", "verdict", F.col("open").alias("size")), "verdicts")
    found = with_group(judged.where("said IS NULL"), verdicts, ["host", "form"]).select("page_id", "host", "path", "rule", "verdict")
    return judged.where("said IS NOT NULL").select("page_id", "host", "path", "rule", F.col("said").alias("verdict")).unionByName(found)


def _descend(rows: DataFrame, level: str, name: str) -> DataFrame:
    """``rows`` (host, above, rest, ...) after ``level`` for each segment until none has a rest; ``above`` becomes ``name``."""
    done = []
    while True:
        rows = stored(rows.sparkSession.sql(level, live=rows), name)
        done.append(rows.where("rest IS NULL"))
        rows = rows.where("rest IS NOT NULL")
        if rows.isEmpty():
            return functools.reduce(DataFrame.unionByName, done).drop("rest").withColumnRenamed("above", name)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_url_filter": op5_url_filter}
#: Written apart from the steps above. Its tree has three levels and siblings do not merge; the tests hold the
#: steps to a plain version that does both.
ORACLES = {
    "op5_url_filter": """
with rules(rule, verdict, rule_host, rule_path) as (values ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
    ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
u as (select row_number() over () as row_no, page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as tail from pages),
p as (select row_no, page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    split_part(split_part(substr(tail, length(regexp_extract(tail, '^[^/?#]*')) + 1), '#', 1), '?', 1) as path from u),
r as (select p.*, rule, verdict as said from p left join rules on (host = rule_host or suffix(host, '.' || rule_host)) and prefix(path, rule_path)
  qualify row_number() over (partition by row_no order by length(rule) desc, rule) = 1),
f as (select *, string_split(regexp_replace(trim(path, '/'), '[0-9]+', '#', 'g'), '/') as seg from r),
s as (select *, seg[1] as s1, coalesce(seg[2], '') as s2, array_to_string(seg[3:], '/') as s3 from f),
c1 as (select host, s1, count(*) as n, count(*) over (partition by host) as many, sum(count(*)) over (partition by host) as total from s group by host, s1),
t1 as (select s.*, case when contains(s.s1, '#') or (many >= 8 and n < 0.02e0 * total) then '?' else s.s1 end as x1 from s join c1 on s.host = c1.host and s.s1 = c1.s1),
c2 as (select host, x1, s2, count(*) as n, count(*) over (partition by host, x1) as many, sum(count(*)) over (partition by host, x1) as total from t1 where len(seg) > 1 group by host, x1, s2),
t2 as (select t1.*, case when contains(t1.s2, '#') or (many >= 8 and n < 0.02e0 * total) then '?' else t1.s2 end as x2
  from t1 left join c2 on t1.host = c2.host and t1.x1 = c2.x1 and t1.s2 = c2.s2 and len(seg) > 1),
t as (select *, case when len(seg) > 2 then x1 || '/' || x2 || '/' || regexp_replace(s3, '[^/]*#[^/]*', '?', 'g') when len(seg) > 1 then x1 || '/' || x2 else x1 end as template from t2),
k as (select *, case when said is not null then 1 else 0 end as known, case when said = 'allow' then 1 else 0 end as good from t),
every as (select (sum(good) + 2e0) / (sum(known) + 4e0) as share from k),
hosts as (select host, (sum(good) + 4e0 * any_value(share)) / (sum(known) + 4e0) as share from k, every group by host),
shared as (select template, sum(good) as good, sum(known) as known from k group by template),
own as (select host, template, sum(good) as good, sum(known) as known from k group by host, template),
purity as (select o.host, o.template, (o.good + 4e0 * ((a.good + 4e0 * h.share) / (a.known + 4e0))) / (o.known + 4e0) as share
  from own o join hosts h on o.host = h.host join shared a on o.template = a.template)
select page_id, k.host, path, rule, coalesce(said, case when share < 0.3e0 then 'block' else 'allow' end) as verdict
from k join purity q on k.host = q.host and k.template = q.template"""
}
