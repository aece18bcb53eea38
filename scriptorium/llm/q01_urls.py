"""op1: a verdict for every page's URL."""

from pyspark.sql import DataFrame, SparkSession

from . import url_filter as U
from ._common import table

RULES = [
    U.Rule("block", "com", "/en/"),
    U.Rule("allow", "example.com", "/en/7"),
    U.Rule("allow", "net", "/de/"),
    U.Rule("block", "example.net", "/de/8"),
    U.Rule("block", "org", "/es/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = U.judge(table(spark, sf_dir, "pages").select("page_id", "url"), "url", RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def sql() -> str:
    """The same rules and tree in DuckDB's SQL, written level by level."""
    p = U.TreeParams()
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    longest = sorted(RULES, key=lambda r: -len(r.text))
    smooth = lambda bad, lab, towards: f"(({bad}) + ({towards}) * {p.strength}::DOUBLE) / (({lab}) + {p.strength}::DOUBLE)"
    share = lambda bad, lab: smooth(bad, lab, f"{p.prior}::DOUBLE")
    parts = [
        r"u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages)",
        "r AS (SELECT *, CASE " + " ".join(f"WHEN {fits(x)} THEN '{x.text}'" for x in longest) + " END AS rule, CASE " + " ".join(f"WHEN {fits(x)} THEN '{x.verdict}'" for x in longest) + " END AS given, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+(\\.[A-Za-z0-9]+)?|[0-9a-fA-F-]{16,}|[0-9]{4}-[0-9]{2}(-[0-9]{2})?') THEN '*' ELSE s END) AS folded FROM u)",
        f"s AS (SELECT *, folded[1:{p.depth}] || CASE WHEN len(folded) > {p.depth} THEN ['**'] ELSE [] END AS shape, CASE given WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS label FROM r)",
        "b AS (SELECT host, shape, count(*) AS n, count(label) AS lab, coalesce(sum(label), 0) AS bad FROM s GROUP BY host, shape)",
        f"t0 AS (SELECT b.*, '' AS template, {share('sum(bad) OVER (PARTITION BY host)', 'sum(lab) OVER (PARTITION BY host)')} AS purity FROM b)",
    ]
    for k in range(p.depth + 2):
        one, spread = share("bad + bad0", "lab + lab0"), f"(1 / (lab + {p.strength}::DOUBLE) + 1 / (lab0 + {p.strength}::DOUBLE))"
        apart = f"coalesce(abs({share('bad', 'lab')} - {share('bad0', 'lab0')}) > {p.z}::DOUBLE * sqrt(({one}) * (1 - ({one})) * {spread}), true)"
        by = "PARTITION BY host, template ORDER BY bucket"
        parts += [
            f"g{k} AS (SELECT *, CASE WHEN len(shape) < {k} THEN NULL WHEN len(shape) = {k} THEN '' ELSE shape[{k + 1}] END AS seg FROM t{k})",
            f"c{k} AS (SELECT host, template, seg, sum(n) AS c_n, sum(lab) AS c_lab, sum(bad) AS c_bad FROM g{k} WHERE seg IS NOT NULL GROUP BY ALL)",
            f"p{k} AS (SELECT *, fan > {p.fan_out} AND c_n < {p.rare_share}::DOUBLE * p_n AS rare FROM (SELECT *, sum(c_n) OVER (PARTITION BY host, template) AS p_n, count(*) FILTER (seg <> '') OVER (PARTITION BY host, template) AS fan FROM c{k}))",
            f"d{k} AS (SELECT *, CASE WHEN seg <> '' AND NOT rare AND c_lab >= {p.strength} THEN CAST(floor(1000 * ({share('c_bad', 'c_lab')})) AS BIGINT) END AS bucket FROM p{k})",
            f"e{k} AS (SELECT *, lag(lab) OVER ({by}) AS lab0, lag(bad) OVER ({by}) AS bad0 FROM (SELECT host, template, bucket, sum(c_lab) AS lab, sum(c_bad) AS bad, count(*) AS branches FROM d{k} WHERE bucket IS NOT NULL GROUP BY ALL))",
            f"f{k} AS (SELECT host, template, bucket, branches, sum(CAST({apart} AS INT)) OVER ({by}) AS kind FROM e{k})",
            f"h{k} AS (SELECT *, sum(branches) OVER (PARTITION BY host, template, kind) AS kin FROM f{k})",
            f"n{k} AS (SELECT d.host, d.template, seg, c_lab, c_bad, seg = '' AS last, d.template || CASE WHEN seg = '' THEN '' WHEN rare THEN '/*' WHEN kin > 1 THEN '/*' || kind ELSE '/' || seg END AS longer FROM d{k} d LEFT JOIN h{k} h ON d.host = h.host AND d.template = h.template AND d.bucket = h.bucket)",
            f"m{k} AS (SELECT *, sum(c_bad) OVER (PARTITION BY host, longer, last) AS t_bad, sum(c_lab) OVER (PARTITION BY host, longer, last) AS t_lab FROM n{k})",
            f"t{k + 1} AS (SELECT g.host, shape, n, lab, bad, coalesce(longer, g.template) AS template, CASE WHEN longer IS NULL THEN purity ELSE {smooth('t_bad', 't_lab', 'purity')} END AS purity FROM g{k} g LEFT JOIN m{k} m ON g.host = m.host AND g.template = m.template AND g.seg = m.seg)",
        ]
    last = f"t{p.depth + 2}"
    return f"WITH {', '.join(parts)} SELECT page_id, s.host, path, rule, coalesce(given, CASE WHEN purity >= {p.reject_at} THEN 'block' ELSE 'allow' END) AS verdict, t.template, purity FROM s JOIN {last} t ON s.host = t.host AND s.shape = t.shape"
