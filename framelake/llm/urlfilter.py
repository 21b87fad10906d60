"""URL filter: fixed rules first, then a tree of path templates per host, judged by smoothed labelled purity.

Native: DataFrame functions only.

1. A URL is cut into host and path; the longest rule whose host is the host or a parent domain of
   it, and whose path begins the path, decides.
2. For the rest, path segments are generalised by form (numbers, hexadecimal ids, dates, mixed
   slugs), which keeps the tree small. A segment of a host's tree whose values are nearly all
   different under one parent becomes the wildcard `*`.
3. Branches under one parent whose children are distributed alike, and whose labelled share is
   alike, merge into `~`. Levels go on as long as some parent has more than one path below it,
   from where these paths part; after that nothing can change, so a path of any depth is judged whole.
4. A template's labels, smoothed by its host's and these by the share over all hosts, give its
   purity; unlabelled URLs of a template or host count for the smoothing, so a few labels do not speak
   for all. Templates with a purity of `reject` or more are blocked.

Labels are the URLs that a rule decides, unless other labels are given.

Defined results: a null URL, or one without `://`, has an empty host and path, gets the template
of the empty host, and is judged like any other; equal URLs get equal verdicts; an empty table
gives no rows; without any label every URL is allowed. Only the id, the URL and the label are
read, so other columns, whatever their names, have no influence.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are kept in the plan, so their number is bounded; more are an error.
MAX_RULES = 1000
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls; rules of equal length: the first given."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # later conditions win, so longer ones do
        own, _, tail = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{tail}"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


#: What stands for variable segments; a literal segment of that name is written with its first letter percent-encoded.
MARKS = ("~", "*", "{n}", "{date}", "{hex}", "{slug}")


def generalised(segment: Column) -> Column:
    """The form of a segment that is variable by its looks, or the segment."""
    ends = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.substr(segment, F.lit(1), F.length(segment) - F.length(ends))
    form = (
        F.when(stem.rlike(r"^\d+$"), "{n}")
        .when(stem.rlike(r"^\d{4}-\d{1,2}(-\d{1,2})?$"), "{date}")
        .when(stem.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), "{hex}")
        .when(stem.rlike(r"\d{2,}") | (F.length(stem) > 40), "{slug}")
        .otherwise(stem)
    )
    literal = F.concat(F.lit("%"), F.hex(F.substr(segment, F.lit(1), F.lit(1))), F.substr(segment, F.lit(2)))
    return F.when(segment.isin(*MARKS), literal).otherwise(F.concat(form, F.lower(ends)))


def templates(urls: DataFrame, least: int = 10, variety: float = 0.5, alike: float = 0.7, weight: float = 5.0) -> DataFrame:
    """The judged tree: host, form, template, purity.

    `urls` has host, form (the path of generalised segments), n, bad and labelled, one row per distinct
    host and form. A level is a wildcard where a parent has at least `least` URLs and more than
    `variety` different values per URL. Branches merge when the overlap of their children's
    distribution with their siblings' is `alike` or more, and their labelled share is within two
    standard errors. All statistics are grouped sums with partial aggregation; each level is a written
    table, and rows meet their parent's statistics without a hot key (`attach`).
    """
    parent, branch_key = ["host", "t"], ["host", "t", "own"]
    columns = ["host", "form", "n", "bad", "labelled", "t"]
    tree = cut(urls.select("host", "form", "n", "bad", "labelled", F.lit("").alias("t")))
    done = []
    depth = F.length("t") - F.length(F.replace(F.col("t"), F.lit("/"), F.lit("")))  # segments that t has taken
    while True:
        rest = tree.select(*columns, F.slice(F.split("form", "/"), depth + 2, F.lit(1 << 30)).alias("rest"))
        own = rest.select("*", F.get("rest", F.lit(0)).alias("own"), F.coalesce(F.get("rest", F.lit(1)), F.lit("")).alias("below"))
        values = own.groupBy(*branch_key).agg(F.count(F.lit(1)).alias("_f"), F.sum("n").alias("_n"), F.min("rest").alias("_lo"), F.max("rest").alias("_hi"))
        stats = values.groupBy(*parent).agg(F.sum("_f").alias("_f"), F.coalesce(F.sum(F.when(F.col("own").isNotNull(), F.col("_n"))), F.lit(0)).alias("_all"), F.count("own").alias("_k"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        wild = (F.col("_all") >= least) & (F.col("_k") > variety * F.col("_all"))
        # where all paths go the same way nothing becomes a wildcard and nothing merges: a path that is alone has its end, several go on to where they part
        apart = F.array_position(F.zip_with("_lo", "_hi", lambda a, b: ~a.eqNullSafe(b)), True)
        alike_for = F.when(apart > 0, apart - 1).otherwise(F.size("_lo")).cast("int")
        stats = cut(stats.select(*parent, wild.alias("_w"), ((F.col("_f") == 1) & ~wild).alias("_s"), F.when((F.col("_k") == 1) & ~wild, alike_for).otherwise(0).alias("_same")))
        here = cut(attach(own, stats, parent))
        settled = F.col("own").isNull() | F.col("_s")
        onward = lambda n: F.concat("t", F.when(n > 0, F.concat(F.lit("/"), F.array_join(F.slice("rest", F.lit(1), n), "/"))).otherwise(""))
        done.append(here.where(settled).select("host", "form", "n", "bad", "labelled", onward(F.size("rest")).alias("t")))
        skipped = here.where(~settled & (F.col("_same") > 0)).select("host", "form", "n", "bad", "labelled", onward(F.col("_same")).alias("t"))
        tree = here.where(~settled & (F.col("_same") == 0)).select(*columns, F.when(F.col("_w"), "*").otherwise(F.col("own")).alias("own"), "below")
        if here.where(~settled).isEmpty():
            break
        branch = cut(tree.groupBy(*branch_key, "below").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "labelled"))))
        pooled = cut(branch.groupBy(*parent, "below").agg(F.sum("n").alias("_pn")))
        of_branch = cut(branch.groupBy(*branch_key).agg(F.sum("n").alias("_bn"), F.sum("bad").alias("_bb"), F.sum("labelled").alias("_bl")))
        of_parent = cut(of_branch.groupBy(*parent).agg(F.sum("_bn").alias("_an"), F.sum("_bb").alias("_ab"), F.sum("_bl").alias("_al"), F.count(F.lit(1)).alias("_k")).where("_k > 1"))
        share, pool = (F.col("_bb") + 0.5) / (F.col("_bl") + 1), (F.col("_ab") + 0.5) / (F.col("_al") + 1)
        near = F.abs(share - pool) <= 2 * F.sqrt(pool * (1 - pool) / (F.col("_bl") + 1))
        close = cut(attach(of_branch, of_parent, parent).where(near).select(*branch_key, "_bn", "_an"))
        overlap = attach(cut(attach(branch, close, branch_key)), pooled, [*parent, "below"])
        overlap = overlap.groupBy(*branch_key).agg(F.sum(F.least(F.col("n") / F.col("_bn"), F.col("_pn") / F.col("_an"))).alias("_o"), F.max("_bn").alias("_bn"))
        merged = cut(overlap.where(F.col("_o") >= alike - 0.5 / F.sqrt("_bn")).select(*branch_key, F.lit(True).alias("_m")))
        tree = attach(tree, merged, branch_key, "left").withColumn("t", F.concat("t", F.lit("/"), F.when(F.col("_m"), "~").otherwise(F.col("own"))))
        tree = cut(tree.select(*columns).union(skipped))
    whole = cut(functools.reduce(DataFrame.union, done))
    leaves = cut(whole.groupBy("host", "t").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "labelled"))))
    hosts = cut(leaves.groupBy("host").agg(F.sum("n").alias("_hn"), F.sum("bad").alias("_hb"), F.sum("labelled").alias("_hl")))
    total = leaves.groupBy().agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")).first()
    prior = (total["b"] or 0) / max(total["l"] or 0, 1)
    of_host = (F.col("_hb") + (weight + F.col("_hn") - F.col("_hl")) * prior) / (weight + F.col("_hn"))
    purity = (F.col("bad") + (weight + F.col("n") - F.col("labelled")) * of_host) / (weight + F.col("n"))
    judged = cut(attach(leaves, hosts, ["host"]).select("host", "t", purity.alias("purity")))
    return attach(whole, judged, ["host", "t"]).select("host", "form", F.col("t").alias("template"), "purity")


def judge(pages: DataFrame, id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, bad: Column | None = None, reject: float = 0.7) -> DataFrame:
    """Every URL judged: id, host, path, rule, verdict, template, purity.

    `bad` (boolean, null: unlabelled) labels rows of `pages`; by default the rules' verdicts do.
    """
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(id).alias("_id"), F.col(url).cast("string").alias("_url"), (F.lit(None).cast("boolean") if bad is None else bad).alias("_bad"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), generalised)
    rows = rows.withColumn("rule", rule).withColumn("_says", says).withColumn("form", F.concat_ws("", F.transform(segments, lambda x: F.concat(F.lit("/"), x))))
    label = F.col("_bad") if bad is not None else F.col("_says") == "block"
    seen = rows.groupBy("host", "form").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(label, 1).otherwise(0)).alias("bad"), F.count(label).alias("labelled"))
    judged = cut(templates(cut(seen)))
    out = attach(rows, judged, ["host", "form"])
    verdict = F.coalesce("_says", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return out.select(F.col("_id").alias(id), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged; the rules' verdicts are the labels."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("purity", F.round("purity", 6) + F.lit(0.0))


#: Levels that the SQL writes out; it fails on a deeper path rather than judge a part of it.
DEPTH = 4


def _oracle() -> str:
    """The same judgement in DuckDB SQL, level by level."""
    marks = ", ".join(f"'{m}'" for m in MARKS).replace("{", "{{").replace("}", "}}")
    form = "(CASE WHEN {s} IN (" + marks + ") THEN '%' || hex(substr({s}, 1, 1)) || substr({s}, 2) ELSE CASE WHEN regexp_matches({m}, '^\\d+$') THEN '{{n}}' WHEN regexp_matches({m}, '^\\d{{4}}-\\d{{1,2}}(-\\d{{1,2}})?$') THEN '{{date}}' WHEN regexp_matches({m}, '^[0-9a-fA-F-]{{8,}}$') AND regexp_matches({m}, '\\d') THEN '{{hex}}' WHEN regexp_matches({m}, '\\d{{2,}}') OR length({m}) > 40 THEN '{{slug}}' ELSE {m} END || lower({e}) END)"
    ends = lambda d: f"regexp_extract(seg[{d}], '(\\.[A-Za-z]{{1,5}})$', 1)"
    stem = lambda d: f"substr(seg[{d}], 1, length(seg[{d}]) - length({ends(d)}))"
    segments = ", ".join(f"coalesce({form.format(s=f"seg[{d}]", m=stem(d), e=ends(d))}, '') AS s{d}" for d in range(1, DEPTH + 1))
    fits = lambda rule: "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}'))".format(*rule.split("/", 1))
    ordered_rules = sorted(RULES, key=lambda r: -len(r[0]))
    case = lambda at: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[at]}'" for r in ordered_rules) + " END"
    names, t = ", ".join(f"s{d}" for d in range(1, DEPTH + 1)), [f"t{d}" for d in range(1, DEPTH + 1)]
    sql = f"""WITH a AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM a),
c AS (SELECT page_id, url, coalesce(translate(raw, '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1), '') AS path FROM b),
d AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM c),
u AS (SELECT CASE WHEN len(seg) > {DEPTH} THEN error('a deeper path') ELSE page_id END AS page_id, host, path, {case(0)} AS rule, {case(1)} AS says, {segments} FROM d),
tree0 AS (SELECT host, {names}, {', '.join(f's{k} AS t{k}' for k in range(1, DEPTH + 1))}, count(*) AS n, sum(CASE WHEN says = 'block' THEN 1 ELSE 0 END) AS bad, count(says) AS labelled FROM u GROUP BY ALL)"""
    for d in range(1, DEPTH + 1):
        parent, own = ", ".join(["host", *t[: d - 1]]), f"t{d}"
        others = ", ".join(x for x in t if x != own)
        sql += f""",
wild{d} AS (SELECT {parent}, true AS w FROM (SELECT {parent}, {own}, sum(n) AS n FROM tree{d - 1} WHERE {own} <> '' GROUP BY ALL) GROUP BY ALL HAVING sum(n) >= 10 AND count(*) > 0.5 * sum(n)),
wilded{d} AS (SELECT host, {names}, {others}, CASE WHEN w AND {own} <> '' THEN '*' ELSE {own} END AS {own}, n, bad, labelled FROM tree{d - 1} LEFT JOIN wild{d} USING ({parent}))"""
        if d == DEPTH:
            sql += f", tree{d} AS (SELECT * FROM wilded{d})"
            break
        sql += f""",
branch{d} AS (SELECT {parent}, {own}, s{d + 1} AS below, sum(n)::DOUBLE AS n, sum(bad) AS b, sum(labelled) AS l FROM wilded{d} WHERE {own} <> '' GROUP BY ALL),
pooled{d} AS (SELECT {parent}, below, sum(n) AS pn FROM branch{d} GROUP BY ALL),
own{d} AS (SELECT {parent}, {own}, sum(n) AS bn, sum(b)::DOUBLE AS bb, sum(l)::DOUBLE AS bl FROM branch{d} GROUP BY ALL),
par{d} AS (SELECT {parent}, sum(bn) AS an, sum(bb) AS ab, sum(bl) AS al, count(*) AS k FROM own{d} GROUP BY ALL),
over{d} AS (SELECT {parent}, {own}, sum(least(n / bn, pn / an)) AS o FROM branch{d} JOIN pooled{d} USING ({parent}, below) JOIN own{d} USING ({parent}, {own}) JOIN par{d} USING ({parent}) GROUP BY ALL),
merged{d} AS (SELECT {parent}, {own}, true AS m FROM over{d} JOIN own{d} USING ({parent}, {own}) JOIN par{d} USING ({parent}) WHERE k > 1 AND o >= 0.7::DOUBLE - 0.5::DOUBLE / sqrt(bn) AND abs((bb + 0.5) / (bl + 1) - (ab + 0.5) / (al + 1)) <= 2 * sqrt((ab + 0.5) / (al + 1) * (1 - (ab + 0.5) / (al + 1)) / (bl + 1))),
tree{d} AS (SELECT host, {names}, {others}, CASE WHEN m THEN '~' ELSE {own} END AS {own}, n, bad, labelled FROM wilded{d} LEFT JOIN merged{d} USING ({parent}, {own}))"""
    levels = ", ".join(t)
    label = " || ".join(f"(CASE WHEN {x} <> '' THEN '/' || {x} ELSE '' END)" for x in t)
    return sql + f""",
leaf AS (SELECT host, {levels}, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(labelled)::DOUBLE AS labelled FROM tree{DEPTH} GROUP BY ALL),
hosts AS (SELECT host, sum(n) AS hn, sum(bad) AS hb, sum(labelled) AS hl FROM leaf GROUP BY ALL),
prior AS (SELECT sum(bad) / greatest(sum(labelled), 1) AS p FROM leaf),
judged AS (SELECT host, {levels}, {label} AS template, round((bad + (5.0::DOUBLE + n - labelled) * ((hb + (5.0::DOUBLE + hn - hl) * p) / (5.0::DOUBLE + hn))) / (5.0::DOUBLE + n), 6) + 0.0 AS purity FROM leaf JOIN hosts USING (host), prior),
placed AS (SELECT host, {names}, template, purity FROM tree{DEPTH} JOIN judged USING (host, {levels}))
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN purity >= 0.7 THEN 'block' ELSE 'allow' END) AS verdict, template, purity FROM u JOIN placed USING (host, {names})"""


OP3_SQL = _oracle()
