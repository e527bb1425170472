"""SQL of the queries that SQL can express, for an independent engine (DuckDB)."""

from __future__ import annotations

from . import ann, mixing, url_rules

WARC = """
    SELECT page_id, url, 200 AS http_status, octet_length(encode(html)) AS n_bytes, md5(html) AS digest
    FROM pages WHERE html IS NOT NULL
"""


NEIGHBOURS = f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = {ann.DIMENSIONS}),
    units AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
    pairs AS (
        SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_inner_product(a.e, b.e) / (a.norm * b.norm), 5) AS similarity
        FROM units a JOIN units b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ann.EVERY} = 0 AND a.norm > 0 AND b.norm > 0 AND isfinite(a.norm) AND isfinite(b.norm)
    ),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour_id) AS INT) AS rank FROM pairs)
    SELECT e.vec_id, r.rank, r.neighbour_id, r.similarity FROM embeddings e LEFT JOIN ranked r ON e.vec_id = r.vec_id AND r.rank <= {ann.NEIGHBOURS}
    WHERE e.vec_id % {ann.EVERY} = 0
"""


def _mixing() -> str:
    knots, temperatures = mixing.KNOTS, mixing.TEMPERATURES
    m = len(knots)
    shares = ", ".join(f"coalesce(pow(supply / nullif(total, 0), CAST({t} AS DOUBLE)), 0) AS w{j}" for j, t in enumerate(temperatures))
    normal = ", ".join(f"coalesce(w{j} / nullif(sum(w{j}) OVER (), 0), 0) AS q{j}" for j in range(m))
    area, integrals = "CAST(0 AS DOUBLE)", []
    for j in range(m):
        if j:
            area += f" + (q{j - 1} + q{j}) * CAST({(knots[j] - knots[j - 1]) / 2} AS DOUBLE)"
        integrals.append(f"{area} AS i{j}")
    t = "CAST(1 AS DOUBLE)"
    for j in reversed(range(m - 1)):
        width = f"CAST({knots[j + 1] - knots[j]} AS DOUBLE)"
        need, slope = f"(target - i{j})", f"((q{j + 1} - q{j}) / {width})"
        root = f"CASE WHEN {need} <= 0 THEN 0 ELSE {need} * 2 / (q{j} + sqrt(greatest(0, q{j} * q{j} + {slope} * {need} * 2))) END"
        t = f"CASE WHEN target <= i{j + 1} THEN CAST({knots[j]} AS DOUBLE) + least({root}, {width}) ELSE {t} END"
    return f"""
    WITH rows AS (
        SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) AS BIGINT) AS tokens,
            CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents
    ),
    placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rows),
    supplies AS (SELECT source, sum(tokens) AS supply FROM rows GROUP BY source),
    weights AS (SELECT source, supply, {shares} FROM (SELECT *, sum(supply) OVER () AS total FROM supplies)),
    shares AS (SELECT source, supply, {normal} FROM weights),
    areas AS (SELECT *, {', '.join(integrals)} FROM shares),
    budgets AS (SELECT *, coalesce(max(supply / nullif(i{m - 1}, 0)) OVER (), 0) AS budget FROM areas),
    demands AS (SELECT *, CAST(round(budget * i{m - 1}) AS BIGINT) AS demand FROM budgets),
    counted AS (
        SELECT p.doc_id, p.tokens, p.start, d.*, CASE WHEN tokens > 0 THEN CAST(ceil((demand - start) / supply) AS BIGINT) WHEN start <= demand OR supply = 0 THEN 1 ELSE 0 END AS times
        FROM placed p JOIN demands d ON p.source IS NOT DISTINCT FROM d.source
    ),
    drawn AS (SELECT *, unnest(range(times)) AS pass FROM counted WHERE times > 0),
    located AS (SELECT *, coalesce((start + pass * supply) / nullif(budget, 0), 0) AS target FROM drawn)
    SELECT doc_id, source, tokens, pass, round({t} * budget, 3) AS position FROM located
    """


def _url_rules() -> str:
    named = lambda name, values: f"list_transform(list_filter({values}, lambda v: v <> ''), lambda v: '{name}=' || v)"
    part = lambda k: f"regexp_extract(low, '{url_rules._URL}', {k})"
    everything = " || ".join([
        named("scheme", "[p1]"), named("label", "CASE WHEN len(parts) > 1 THEN parts[1:len(parts) - 2] ELSE parts END"),
        named("word", "flatten(list_transform(list_filter(parts, lambda v: regexp_matches(v, '[-_]')), lambda v: regexp_split_to_array(v, '[-_]')))"),
        named("domain", "CASE WHEN len(parts) > 1 THEN [array_to_string(parts[-2:], '.')] ELSE [''] END"), named("top", "CASE WHEN len(parts) > 1 THEN parts[-1:] ELSE [''] END"),
        named("path", "string_split(regexp_replace(p3, '[0-9]+', '#', 'g'), '/')"), named("ending", "[regexp_extract(p3, '\\.([a-z0-9]{1,5})$', 1)]"),
        named("query", "list_transform(regexp_split_to_array(p4, '[&;]'), lambda q: regexp_extract(q, '^([^=]*)', 1))"), named("fragment", "[regexp_replace(p5, '[0-9]+', '#', 'g')]"),
    ])
    return f"""
    WITH RECURSIVE low AS (SELECT page_id, url, lower(coalesce(url, '')) AS low FROM pages),
    cut AS (SELECT page_id, url, {', '.join(f'{part(k)} AS p{k}' for k in range(1, 6))} FROM low),
    tokens AS (SELECT page_id, url, list_sort(list_distinct({everything})) AS have FROM (SELECT *, string_split(p2, '.') AS parts FROM cut)),
    verdicts AS (SELECT doc_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
    labelled AS (SELECT row_number() OVER () AS url_id, have, bad FROM tokens JOIN verdicts ON page_id = doc_id),
    size AS (SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad, ceil(count(*) * greatest({url_rules.MIN_SUPPORT}, {url_rules.MIN_COUNT - 0.5} / count(*))) AS least FROM labelled),
    listed AS (SELECT url_id, bad, unnest(have) AS tok FROM labelled),
    telling AS (SELECT min(tok) AS tok FROM (SELECT tok, list(url_id ORDER BY url_id) AS ids, count(*) AS held FROM listed GROUP BY tok), size WHERE held >= least GROUP BY ids),
    t AS (SELECT url_id, bad, tok FROM listed WHERE tok IN (SELECT tok FROM telling)),
    combined AS (
        SELECT url_id, bad, [tok] AS toks FROM t UNION ALL SELECT c.url_id, c.bad, list_append(c.toks, t.tok) FROM combined c JOIN t ON c.url_id = t.url_id AND t.tok > c.toks[-1]
    ),
    sets AS (SELECT toks, count(*) AS freq, count(*) FILTER (WHERE bad) AS support FROM combined GROUP BY toks),
    confident AS (
        SELECT toks, support, support / freq AS confidence FROM sets, size
        WHERE support >= least AND support / freq >= {url_rules.MIN_CONFIDENCE} AND support / freq >= {url_rules.MIN_LIFT} * n_bad / n
    ),
    rules AS (
        SELECT * FROM confident r WHERE NOT EXISTS (SELECT 1 FROM confident p WHERE len(p.toks) < len(r.toks) AND list_has_all(r.toks, p.toks) AND p.confidence >= r.confidence)
    ),
    met AS (
        SELECT page_id, url, confidence, array_to_string(toks, ' ') AS rule, count(*) OVER (PARTITION BY page_id) AS n_rules,
            row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, support DESC, array_to_string(toks, ' ')) AS rn
        FROM tokens JOIN rules ON list_has_all(have, toks)
    )
    SELECT p.page_id, coalesce(m.n_rules, 0) AS n_rules, round(m.confidence, 6) AS confidence, m.rule, m.rule IS NOT NULL AS rejected FROM pages p LEFT JOIN met m ON p.page_id = m.page_id AND rn = 1
    """


def oracle_sql() -> dict[str, str]:
    return {"op3_url_rules": _url_rules(), "op6_mixing": _mixing(), "op8_warc": WARC, "op9_ann": NEIGHBOURS}
