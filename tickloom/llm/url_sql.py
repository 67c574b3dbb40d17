"""SQL of the path-template tree, one step per level."""

from __future__ import annotations

from tickloom.llm.url_templates import BOUND, DEPTH, LEAST_PURITY, LEAST_ROWS, MERGED, RULES, SHARE, VARIED, WEIGHT


def _rule(column: str) -> str:
    cases = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, column)}'"
        for r in sorted(RULES, key=lambda r: (-len(r.name), r.name))
    )
    return f"CASE {cases} END"


def _differs(part: str, whole: str) -> str:
    return f"""(b.{whole} > 0 AND abs(b.{part} / b.{whole} - n.{part} / n.{whole})
               > {BOUND!r}::DOUBLE * (1 / sqrt(b.{whole}::DOUBLE) + 1 / sqrt(n.{whole}::DOUBLE)))"""


def _level(d: int) -> str:
    return f"""
    here{d} AS (
        SELECT *, string_split(shape, '/')[{d + 1}] AS segment,
               CASE WHEN len(string_split(shape, '/')) = {d + 1} THEN urls ELSE 0 END AS ending FROM leaves{d - 1}),
    branches{d} AS (
        SELECT host, template, segment, sum(urls) AS urls, sum(labelled) AS labelled, sum(bad) AS bad, sum(ending) AS ending
        FROM here{d} WHERE segment IS NOT NULL GROUP BY ALL),
    nodes{d} AS (
        SELECT host, template, sum(urls) AS urls, sum(labelled) AS labelled, sum(bad) AS bad, sum(ending) AS ending
        FROM branches{d} GROUP BY ALL),
    literal{d} AS (
        SELECT b.host, b.template, b.segment FROM branches{d} b JOIN nodes{d} n USING (host, template)
        WHERE b.urls >= {LEAST_ROWS} AND b.urls * {SHARE} >= n.urls AND ({_differs('bad', 'labelled')} OR {_differs('ending', 'urls')})),
    leaves{d} AS (
        SELECT host, shape, urls, labelled, bad,
               CASE WHEN h.segment IS NULL THEN template ELSE template || '/' || coalesce(l.segment, '{MERGED}') END AS template
        FROM here{d} h LEFT JOIN literal{d} l USING (host, template, segment))"""


TEMPLATE_SQL = rf"""
    WITH parsed AS (
        SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    ruled AS (
        SELECT *, {_rule('name')} AS rule, {_rule('verdict')} AS ruling,
               string_split(regexp_replace(regexp_replace(path, '[0-9A-Fa-f]{{16,}}', '{VARIED}', 'g'), '[0-9]+', '{VARIED}', 'g'), '/') AS s
        FROM parsed),
    shaped AS (
        SELECT page_id, host, path, rule, ruling, CASE ruling WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad,
               array_to_string(list_slice(s, 1, {DEPTH + 1}), '/') || CASE WHEN len(s) > {DEPTH + 1} THEN '/{MERGED}' ELSE '' END AS shape
        FROM ruled),
    leaves0 AS (
        SELECT host, shape, '' AS template, count(*) AS urls, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM shaped GROUP BY ALL),
    {','.join(_level(d) for d in range(1, DEPTH + 1))},
    hosts AS (SELECT host, sum(labelled) AS labelled, sum(bad) AS bad FROM leaves{DEPTH} GROUP BY host),
    overall AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0) AS share FROM hosts),
    pure AS (
        SELECT t.host, t.template,
               1 - (t.bad + {WEIGHT!r}::DOUBLE * ((h.bad + {WEIGHT!r}::DOUBLE * o.share) / (h.labelled + {WEIGHT!r}::DOUBLE)))
                   / (t.labelled + {WEIGHT!r}::DOUBLE) AS purity
        FROM (SELECT host, template, sum(labelled) AS labelled, sum(bad) AS bad FROM leaves{DEPTH} GROUP BY ALL) t
        JOIN hosts h USING (host), overall o)
    SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN purity < {LEAST_PURITY!r}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, template
    FROM shaped JOIN leaves{DEPTH} USING (host, shape) JOIN pure USING (host, template)
    """
