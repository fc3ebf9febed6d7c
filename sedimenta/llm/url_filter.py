"""URL filters: rules first, then trust and distrust spread over the links between hosts. DataFrame functions only.

Trust is a personalised PageRank that starts at the hosts whose pages rules allow; distrust starts at those whose pages
rules block and runs against the links, to hosts that link there. Both count in pages, so they can be compared; a
host is blocked by the share of distrust in both, more than half by default. Sums are of whole numbers, so results don't hang on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidied, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of each rule of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Mass of all seeds in the reported figures; percent of the mass that follows links; steps of those figures, and how many
#: steps go into one plan.
SCALE, FOLLOW, STEPS, CHUNK = 10**12, 85, 20, 5
#: Verdicts: the relative change in CHUNK steps up to which a host's mass counts as settled, how much more distrust than
#: trust blocks (relative), and the steps after which a spread that hasn't settled is an error.
TOLERANCE, MARGIN, LIMIT = 1e-6, 1e-10, 2000
#: The share of distrust in a host's trust and distrust beyond which it is blocked.
THRESHOLD = 0.5
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The index in rules of the longest rule that fits, else null. Rules are a short list that is written in full
    into the plan."""
    out = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i][1]) + len(rules[i][2]), -i)):
        _, h, p = rules[i]
        out = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), i).otherwise(out)
    return out


def _pick(index: Column, values: list[str]) -> Column:
    out = F.lit(None).cast("string")
    for i, value in enumerate(values):
        out = F.when(index == i, value).otherwise(out)
    return out


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts, from the href of every page that names a host."""
    rows = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("dst"))
    rows = rows.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' and src <> dst")
    return rows.groupBy("src", "dst").agg(F.count("*").alias("links"))


def link_ways(links: DataFrame) -> DataFrame:
    """(kind, host, to, links, total): where trust and distrust at a host go, by links of all its links that way."""
    out, into = links.groupBy("src").agg(F.sum("links").alias("total")), links.groupBy("dst").agg(F.sum("links").alias("total"))
    ways = links.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links", "total")
    return written(ways.union(links.join(into, "dst").select(F.lit("distrust"), "dst", "src", "links", "total")), "host-ways")


def spread(seeds: DataFrame, ways: DataFrame, steps: int = STEPS) -> DataFrame:
    """(kind, host, mass): the reported figures, from seeds (kind, host, mass). Each share is rounded down to a whole
    number and only `steps` steps are made, so small and far shares are lost: verdicts rest on settled() instead.

    Mass at a host without links that way is lost. Steps end early once nothing changes."""
    now, before = seeds, None
    for step in range(1, steps + 1):
        moved = now.join(ways, ["kind", "host"]).select("kind", F.col("to").alias("host"), F.expr("(cast(mass as decimal(19, 0)) * cast(links as decimal(19, 0))) div total").alias("inflow"), F.lit(0).cast("long").alias("seed"))
        both = moved.union(seeds.select("kind", "host", F.lit(0).cast("long"), "mass"))
        now = both.groupBy("kind", "host").agg(F.expr(f"(sum(inflow) * {FOLLOW}) div 100 + (sum(seed) * {100 - FOLLOW}) div 100").alias("mass"))
        if step % CHUNK == 0 or step == steps:
            now = written(now, "host-mass")
            state = now.agg(F.count("*"), F.sum(F.xxhash64("kind", "host", "mass").cast("decimal(38,0)"))).first()
            if state == before:
                break
            before = state
    return now


def _sums(rows: DataFrame) -> DataFrame:
    """(kind, host, mass): sums of the positive doubles `mass`, the same in any order. Each is rounded to 16 digits or more
    as a whole number of units of its own power of 10**9; units are added exactly, then the few powers from the smallest up."""
    tiny = F.when(F.col("mass") < 1e-300, F.raise_error(F.lit("url_filter: a share is too small for a double"))).otherwise(F.col("mass"))
    parts = rows.select("kind", "host", tiny.alias("mass")).withColumn("part", F.expr("cast(-ceil(-log10(mass) / 9) as int)"))
    parts = parts.withColumn("units", F.expr("cast(mass * pow(10D, -9 * part) * 1e15D as decimal(28, 0))"))
    parts = parts.groupBy("kind", "host", "part").agg(F.sum("units").alias("units"))
    total = "aggregate(array_sort(collect_list(struct(part, units))), 0D, (a, x) -> a + cast(x.units as double) / 1e15D * pow(10D, 9 * x.part))"
    return parts.groupBy("kind", "host").agg(F.expr(total).alias("mass"))


def settled(seeds: DataFrame, ways: DataFrame, tolerance: float = TOLERANCE, limit: int = LIMIT) -> DataFrame:
    """(kind, host, mass): trust along the links and distrust against them, from seeds (kind, host, pages), in pages.

    Doubles, so that shares keep their precision however small they are and whatever else the corpus holds; one below
    1e-300 raises. Steps go on until CHUNK of them reach no new host and change no mass by more than `tolerance` of it;
    later steps then change it by no more each. RuntimeError if that takes over `limit` steps. Mass at a host without
    links that way is lost."""
    start = seeds.select("kind", "host", F.expr(f"cast(pages as double) * {100 - FOLLOW} / 100").alias("mass"))
    now = before = written(start, "host-shares")
    for step in range(1, limit + 1):
        moved = now.join(ways, ["kind", "host"]).select("kind", F.col("to").alias("host"), F.expr(f"cast(mass * {FOLLOW} / 100 * links / total as double)").alias("mass"))
        now = written(_sums(moved.union(start)), "host-shares")
        if step % CHUNK == 0 or step == limit:
            held = now.join(before.withColumnRenamed("mass", "held"), ["kind", "host"], "left")
            if held.where(F.coalesce(F.abs(F.col("mass") - F.col("held")), F.col("mass")) > tolerance * F.col("mass")).isEmpty():
                return now
            before = now
    raise RuntimeError(f"trust and distrust did not settle in {limit} steps")


def by_host(mass: DataFrame, trust: str, distrust: str) -> DataFrame:
    """(of_host, trust, distrust) from (kind, host, mass); null where a host has none."""
    return mass.groupBy(F.col("host").alias("of_host")).agg(*[F.sum(F.when(F.col("kind") == k, F.col("mass"))).alias(n) for k, n in (("trust", trust), ("distrust", distrust))])


@tidied
def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, host, path, rule, verdict, trust, distrust, trust_pages, distrust_pages) for every row of pages.

    The host is what stands after the first :// up to /, ? or #, with A to Z lower-cased; the path follows up to ? or #.
    A url that is null or has no :// has empty both; such pages seed nothing, get no rule and are allowed. The longest
    rule that fits decides (the first of equals); else the host's trust_pages and distrust_pages do: settled() masses to
    a relative TOLERANCE a step, where a host is blocked if distrust is more than `threshold` of both together, by over a
    relative MARGIN; a host that neither reaches is allowed. trust and
    distrust are whole-number figures of STEPS steps, of SCALE for all ruled pages, and may be 0 where the masses aren't.
    Null html has no links. Repeated rows each give a row and count as often. Other columns aren't read.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("at", rule_of(F.col("host"), F.col("path"), rules))
    ruled = _pick(F.col("at"), [v for v, _, _ in rules])
    seeds = rows.where("at is not null and host <> ''").select(F.when(ruled == "allow", "trust").otherwise("distrust").alias("kind"), "host").groupBy("kind", "host").agg(F.count("*").alias("pages"))
    seeds = written(seeds, "seed-pages")
    total = seeds.agg(F.sum("pages")).first()[0] or 1
    ways = link_ways(written(host_links(pages, url_col, html_col), "host-links"))
    whole = spread(seeds.select("kind", "host", F.expr(f"({SCALE} * cast(pages as decimal(19, 0))) div {total}").alias("mass")), ways)
    hosts = by_host(whole, "trust", "distrust").join(by_host(settled(seeds, ways), "trust_pages", "distrust_pages"), "of_host", "full")
    rows = rows.join(written(hosts, "host-verdicts"), F.col("host") == F.col("of_host"), "left").fillna(0, ["trust", "distrust", "trust_pages", "distrust_pages"])
    verdict = F.coalesce(ruled, F.when(F.col("distrust_pages") * (1 - threshold) > F.col("trust_pages") * threshold * (1 + MARGIN), "block").otherwise("allow"))
    return rows.select(F.col("page_id").alias(id_col), "host", "path", _pick(F.col("at"), [h + p for _, h, p in rules]).alias("rule"), verdict.alias("verdict"), "trust", "distrust", "trust_pages", "distrust_pages")


def op8(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("trust_pages", "distrust_pages")


def _sql() -> str:
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    pick = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(v, h, p)}'" for v, h, p in order) + " END"
    low = f"'{UPPER}', '{LOWER}'"
    link = LINK.replace("'", "''")
    steps = [f"m0 AS (SELECT kind, host, {SCALE}::HUGEINT * pages // (SELECT sum(pages) FROM sp) AS mass FROM sp)"]
    for i in range(1, STEPS + 1):
        steps.append(f"m{i} AS (SELECT kind, host, sum(inflow) * {FOLLOW} // 100 + sum(seed) * {100 - FOLLOW} // 100 AS mass FROM (SELECT w.kind, w.dst AS host, m.mass * w.links // w.total AS inflow, 0::HUGEINT AS seed FROM m{i - 1} m JOIN w ON m.kind = w.kind AND m.host = w.src UNION ALL SELECT kind, host, 0, mass FROM m0) GROUP BY kind, host)")
    return f"""
WITH u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {low}) AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT page_id, host, path, {pick(lambda v, h, p: h + p)} AS rule, {pick(lambda v, h, p: v)} AS ruled FROM u),
sp AS (SELECT CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS pages FROM r WHERE ruled IS NOT NULL AND host <> '' GROUP BY 1, 2),
l AS (SELECT src, dst, count(*) AS links FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), {low}) AS dst FROM u) WHERE src <> '' AND src <> dst GROUP BY 1, 2),
w AS (SELECT 'trust' AS kind, src, dst, links, sum(links) OVER (PARTITION BY src) AS total FROM l
  UNION ALL SELECT 'distrust', dst, src, links, sum(links) OVER (PARTITION BY dst) FROM l),
{", ".join(steps)},
h AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust FROM m{STEPS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust
FROM r LEFT JOIN h USING (host)
"""


OP8_SQL = _sql()
