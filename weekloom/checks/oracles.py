"""The same results in plain SQL, for DuckDB over the same test tables."""

from __future__ import annotations

from weekloom import vocab
from weekloom.checks import samples as S
from weekloom.operators import people


def _rows(rows) -> str:
    def lit(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


# Tokens are compared instead of `\b` patterns: DuckDB's `\b` knows ASCII words only.
_BASE = [
    f"lexicon AS (SELECT * FROM (VALUES {_rows(S.LEXICON)}) t(entity_id, ord, name, pattern))",
    f"outlets AS (SELECT * FROM (VALUES {_rows(S.OUTLETS)}) t(id, name))",
    f"topics AS (SELECT * FROM (VALUES {_rows(vocab.TOPICS.items())}) t(topic_id, topic))",
    """articles AS (
  SELECT doc_id AS article_id, 'doc://' || doc_id AS link, substr(text, 1, 80) AS title, text AS full_text,
         CAST(substr(source, 4, 10) AS INTEGER) % 3 + 1 AS outlet_id,
         TIMESTAMP '2025-05-19 00:00:00' + to_hours(CAST(doc_id * 7919 % 2016 AS INTEGER)) AS publication_date
  FROM documents)""",
    r"""tokens AS (
  SELECT article_id,
         list_filter(regexp_split_to_array(lower(full_text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS tk
  FROM articles)""",
    """all_counts AS (
  SELECT t.article_id, l.entity_id, l.ord, l.name,
         CAST(len(list_filter(tk, lambda x: list_contains(string_split(l.pattern, '|'), x))) AS BIGINT) AS cnt
  FROM tokens t CROSS JOIN lexicon l)""",
    "entity_counts AS (SELECT * FROM all_counts WHERE cnt >= 1)",
    "article_entities AS (SELECT article_id, entity_id FROM entity_counts)",
    """weekly_topic AS (
  SELECT ae.entity_id, CAST(date_trunc('week', a.publication_date) AS DATE) AS week_start,
         CAST(date_trunc('week', a.publication_date) + INTERVAL 6 DAY AS DATE) AS week_end, ae.article_id,
         CASE WHEN ae.article_id % 7 = 0 THEN NULL ELSE CAST(ae.article_id * 31 % 5 AS INTEGER) END AS cluster_id,
         l.quality + 2 * l.toxic AS topic_id, CAST(NULL AS DOUBLE) AS topic_probability
  FROM article_entities ae JOIN articles a ON a.article_id = ae.article_id
  LEFT JOIN labels l ON l.doc_id = ae.article_id)""",
    """weekly_clusters AS (
  SELECT entity_id, week_start, cluster_id, count(*) AS size FROM weekly_topic
  WHERE cluster_id IS NOT NULL GROUP BY ALL)""",
    """kw_counts AS (
  SELECT w.entity_id, w.week_start, w.cluster_id, k.tok, count(*) AS cnt
  FROM weekly_topic w JOIN (SELECT article_id, unnest(tk) AS tok FROM tokens) k ON k.article_id = w.article_id
  WHERE w.cluster_id IS NOT NULL AND length(k.tok) >= 5 GROUP BY ALL)""",
    """weekly_keywords AS (
  SELECT entity_id, week_start, cluster_id, tok AS keyword,
         round(CAST(cnt AS DOUBLE) / CAST(total AS DOUBLE), 6)
           * CASE WHEN length(tok) % 5 = 0 THEN -1 ELSE 1 END AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, week_start, cluster_id ORDER BY cnt DESC, tok) AS rn,
               sum(cnt) OVER (PARTITION BY entity_id, week_start, cluster_id) AS total FROM kw_counts)
  WHERE rn <= 12)""",
    """week_articles AS (
  SELECT w.entity_id, w.week_start, w.cluster_id, w.article_id, w.topic_id, a.link, a.title,
         CAST(a.publication_date AS DATE) AS publication_date, o.name AS outlet
  FROM weekly_topic w JOIN articles a ON a.article_id = w.article_id JOIN outlets o ON o.id = a.outlet_id)""",
    """keyword_strings AS (
  SELECT k.entity_id, k.week_start, k.cluster_id,
         string_agg(keyword || ':' || printf('%.6f', score), ',' ORDER BY abs(score) DESC, keyword) AS keywords
  FROM weekly_keywords k JOIN weekly_clusters c
    ON c.entity_id = k.entity_id AND c.week_start = k.week_start AND c.cluster_id = k.cluster_id
  GROUP BY ALL)""",
]


def _with(sql: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([*_BASE, *more]) + "\n" + sql.strip()


_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)

_SCRAPED = [
    """first_rows AS (
  SELECT a.link, 'new ' || a.title AS title, 's1' AS summary, a.publication_date, d.lang AS author,
         a.full_text, a.outlet_id, d.lang, 1 AS order_no, a.article_id
  FROM articles a JOIN documents d ON d.doc_id = a.article_id)""",
    """known AS (SELECT article_id AS id, link FROM first_rows WHERE lang = 'en')""",
    """last_rows AS (
  SELECT f.link, coalesce('again ' || l.quality, f.title) AS title,
         CASE WHEN l.doc_id IS NULL THEN 's1' ELSE 's2' END AS summary
  FROM first_rows f LEFT JOIN labels l ON l.doc_id = f.article_id)""",
    """author_ids AS (
  SELECT 'en' AS name, CAST(7 AS BIGINT) AS id
  UNION ALL
  SELECT name, 7 + row_number() OVER (ORDER BY md5('|' || name))
  FROM (SELECT DISTINCT lang AS name FROM documents WHERE lang <> 'en'))""",
    """article_ids AS (
  SELECT link, id FROM known
  UNION ALL
  SELECT link, (SELECT max(id) FROM known) + row_number() OVER (ORDER BY md5('|' || link))
  FROM first_rows WHERE lang <> 'en')""",
]

_LABELS = """given AS (
  SELECT ae.article_id + b.shift AS article_id, ae.entity_id,
         CAST((l.quality + 3 * l.toxic + 1) % 7 AS INTEGER) AS topic
  FROM article_entities ae JOIN labels l ON l.doc_id = ae.article_id
  CROSS JOIN (VALUES (0), (1000000)) b(shift))"""

_BACKLOG = """open_rows AS (
  SELECT * FROM weekly_topic WHERE week_end < DATE '2025-07-16')"""

# k-means in SQL: the seeds are drawn one after the other, then 20 rounds of assignment
# and averaging, for all groups and all k at a time.
_KMEANS = [
    f"""points AS (
  SELECT w.entity_id, w.week_start, w.article_id, count(*) OVER (PARTITION BY w.entity_id, w.week_start) AS n,
         list_concat(CAST(e.embedding AS DOUBLE[]),
           list_transform(range({len(vocab.TOPICS)}), lambda i: CASE WHEN w.topic_id = i THEN 1.0e0 ELSE 0.0e0 END),
           [CASE WHEN w.topic_id IS NULL THEN 1.0e0 ELSE 0.0e0 END]) AS x
  FROM weekly_topic w JOIN embeddings e ON e.vec_id = w.article_id)""",
    """pairs AS (
  SELECT a.entity_id, a.week_start, a.article_id AS p, b.article_id AS q, a.n,
         list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))) AS d
  FROM points a JOIN points b ON a.entity_id = b.entity_id AND a.week_start = b.week_start WHERE a.n >= 2)""",
    """draws AS (
  SELECT p.article_id, j.pick,
         -ln((CAST('0x' || substr(md5('42|' || j.pick || '|' || p.article_id), 1, 13) AS BIGINT) + 1) / 4503599627370496.0e0) AS e
  FROM (SELECT DISTINCT article_id FROM points) p
  CROSS JOIN (SELECT unnest(range(greatest(2, max(n) // 2))) AS pick FROM points) j)""",
    """picks AS (
  SELECT entity_id, week_start, 0 AS j, [arg_min(p.article_id, e)] AS picked
  FROM points p JOIN draws d ON d.article_id = p.article_id AND d.pick = 0 WHERE n >= 2
  GROUP BY entity_id, week_start
  UNION ALL
  SELECT entity_id, week_start, j + 1, list_append(any_value(picked), arg_min(p, e / near))
  FROM (SELECT k.entity_id, k.week_start, k.j, any_value(k.picked) AS picked, d.p, min(d.d) AS near, any_value(r.e) AS e
        FROM picks k
        JOIN pairs d ON d.entity_id = k.entity_id AND d.week_start = k.week_start AND list_contains(k.picked, d.q)
        JOIN draws r ON r.article_id = d.p AND r.pick = k.j + 1
        WHERE k.j + 1 < greatest(2, d.n // 2)
        GROUP BY k.entity_id, k.week_start, k.j, d.p) WHERE near > 0
  GROUP BY entity_id, week_start, j)""",
    """centres AS (
  SELECT s.entity_id, s.week_start, CAST(k.k AS INTEGER) AS k, 0 AS it, s.j AS c, p.x
  FROM (SELECT entity_id, week_start, j, picked[len(picked)] AS article_id FROM picks) s
  JOIN points p ON p.entity_id = s.entity_id AND p.week_start = s.week_start AND p.article_id = s.article_id
  JOIN (SELECT DISTINCT entity_id, week_start, unnest(range(2, greatest(2, n // 2) + 1)) AS k FROM points WHERE n >= 2) k
    ON k.entity_id = s.entity_id AND k.week_start = s.week_start AND s.j < k.k
  UNION ALL
  SELECT o.entity_id, o.week_start, o.k, o.it + 1, o.c, coalesce(m.x, o.x)
  FROM centres o LEFT JOIN (
    SELECT entity_id, week_start, k, c, list(v ORDER BY i) AS x
    FROM (SELECT l.entity_id, l.week_start, l.k, l.c, i.i, avg(l.x[i.i]) AS v
          FROM (SELECT p.entity_id, p.week_start, c.k, p.article_id, any_value(p.x) AS x,
                       arg_min(c.c, (list_sum(list_transform(range(1, len(p.x) + 1),
                         lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))), c.c)) AS c
                FROM points p JOIN centres c ON c.entity_id = p.entity_id AND c.week_start = p.week_start
                GROUP BY p.entity_id, p.week_start, c.k, p.article_id) l
          CROSS JOIN (SELECT unnest(range(1, 73)) AS i) i GROUP BY ALL)
    GROUP BY ALL) m ON m.entity_id = o.entity_id AND m.week_start = o.week_start AND m.k = o.k AND m.c = o.c
  WHERE o.it < 20)""",
    """placed AS (
  SELECT entity_id, week_start, k, article_id, min(dist) AS dist, arg_min(c, (dist, c)) AS c
  FROM (SELECT p.entity_id, p.week_start, p.article_id, c.k, c.c, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))) AS dist
        FROM points p JOIN (SELECT * FROM centres WHERE it = 20) c
          ON c.entity_id = p.entity_id AND c.week_start = p.week_start)
  GROUP BY ALL)""",
]

_PHRASES = [
          rf"""words AS (
    SELECT article_id, list_filter(tk, lambda x: NOT regexp_full_match(x, '\p{{Nd}}+') AND x NOT IN ({_STOP})) AS w
    FROM tokens)""",
          """phrases AS (
    SELECT article_id, unnest(w) AS keyword FROM words
    UNION ALL
    SELECT article_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words)""",
]

_NAMES = r"""names AS (
SELECT article_id, lower(unnest(regexp_extract_all(full_text,
  '\p{Lu}[\p{L}\p{N}_]*(?: \p{Lu}[\p{L}\p{N}_]*){1,2}'))) AS keyword FROM articles)"""

_BEST = [
          """curves AS (
  SELECT entity_id, week_start, k, sum(dist) AS inertia FROM placed GROUP BY ALL)""",
          """best AS (
  SELECT entity_id, week_start, k FROM (
      SELECT *, row_number() OVER (PARTITION BY entity_id, week_start ORDER BY off DESC, k) AS rn
      FROM (SELECT *, CASE WHEN d <= 1e-9 * abs(i0 - i1) THEN 0.0e0 ELSE d END AS off
            FROM (SELECT *, abs(inertia - (i0 - (k - k0) * ((i0 - i1) / greatest(k1 - k0, 1)))) AS d
                  FROM (SELECT *, min(k) OVER e AS k0, max(k) OVER e AS k1,
                               arg_min(inertia, k) OVER e AS i0, arg_max(inertia, k) OVER e AS i1
                        FROM curves WINDOW e AS (PARTITION BY entity_id, week_start)))))
    WHERE rn = 1)""",
]

_JUDGED = """judged AS (
  SELECT quality + 2 * toxic AS label,
         CASE WHEN doc_id % 5 = 0 THEN (quality + 2 * toxic + 1) % 4 ELSE quality + 2 * toxic END AS prediction
  FROM labels)"""


def _scored(counts: str) -> str:
    return f"""
SELECT entity_id, week_start, cluster_id, keyword, cnt, round(score, 6) AS score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY entity_id, week_start, cluster_id
                                    ORDER BY score DESC, keyword) AS INTEGER) AS rank
  FROM (SELECT c.*, CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY entity_id, week_start, cluster_id)
               * ln(1.0e0 + (SELECT avg(n) FROM (SELECT sum(cnt) AS n FROM {counts}
                                               GROUP BY entity_id, week_start, cluster_id))
                    / sum(cnt) OVER (PARTITION BY keyword)) AS score
        FROM {counts} c))
WHERE rank <= 10"""


def all_oracles() -> dict[str, str]:
    q: dict[str, str] = {}

    # ---- weekly read models
    q["topic_trend"] = _with(
        """
SELECT entity_id, week_start, c.topic_id, topic, cnt, total, round(cnt / total * 100, 6) AS pct
FROM (SELECT *, CAST(sum(cnt) OVER (PARTITION BY entity_id, week_start) AS BIGINT) AS total,
             dense_rank() OVER (PARTITION BY entity_id ORDER BY week_start DESC) AS recent
      FROM (SELECT entity_id, week_start, topic_id, count(*) AS cnt FROM weekly_topic
            WHERE week_start BETWEEN DATE '2025-06-01' AND DATE '2025-08-10' GROUP BY ALL)) c
LEFT JOIN topics t ON t.topic_id = c.topic_id
WHERE recent <= 8"""
    )
    q["week_table"] = _with(
        """
SELECT a.entity_id, a.week_start, a.cluster_id, article_id, topic_id AS topic, link, title, publication_date,
       outlet, keywords,
       replace(coalesce(regexp_replace(keywords, ':[^,]*', '', 'g'), ''), ',', '|') AS keyword_list
FROM week_articles a LEFT JOIN keyword_strings k
  ON k.entity_id = a.entity_id AND k.week_start = a.week_start AND k.cluster_id = a.cluster_id"""
    )
    q["week_table_one_topic"] = _with(
        """
SELECT entity_id, week_start, cluster_id, article_id, topic_id, link, publication_date, outlet
FROM week_articles WHERE entity_id = 6 AND week_start = DATE '2025-06-16' AND topic_id IN (1)"""
    )
    q["week_metrics"] = _with(
        """
SELECT m.entity_id, m.week_start, n_articles, n_storylines, d.topic_id AS dominant_topic_id,
       coalesce(t.topic, 'N/A') AS dominant_topic
FROM (SELECT entity_id, week_start, count(*) AS n_articles, count(DISTINCT cluster_id) AS n_storylines
      FROM week_articles GROUP BY ALL) m
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY entity_id, week_start ORDER BY n DESC, topic_id) AS rn
           FROM (SELECT entity_id, week_start, topic_id, count(*) AS n FROM week_articles
                 WHERE topic_id IS NOT NULL GROUP BY ALL)) d
  ON d.entity_id = m.entity_id AND d.week_start = m.week_start AND d.rn = 1
LEFT JOIN topics t ON t.topic_id = d.topic_id"""
    )
    q["topic_overview"] = _with(
        """
SELECT entity_id, week_start, a.topic_id, topic, count(*) AS n
FROM week_articles a JOIN topics t ON t.topic_id = a.topic_id GROUP BY ALL"""
    )
    q["storyline_cards"] = _with(
        """
SELECT s.entity_id, s.week_start, s.cluster_id, s.cluster_id + 1 AS storyline_no, n_articles, d.topic_id,
       coalesce(t.topic, 'Unknown') AS topic, l.article_id, l.title, l.link, l.outlet, l.publication_date
FROM (SELECT entity_id, week_start, cluster_id, count(*) AS n_articles FROM week_articles
      WHERE cluster_id IS NOT NULL GROUP BY ALL) s
JOIN (SELECT *, row_number() OVER (PARTITION BY entity_id, week_start, cluster_id
                                   ORDER BY publication_date DESC, article_id) AS rn FROM week_articles) l
  ON l.entity_id = s.entity_id AND l.week_start = s.week_start AND l.cluster_id = s.cluster_id AND l.rn = 1
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY entity_id, week_start, cluster_id
                                        ORDER BY n DESC, topic_id) AS rn
           FROM (SELECT entity_id, week_start, cluster_id, topic_id, count(*) AS n FROM week_articles
                 WHERE topic_id IS NOT NULL GROUP BY ALL)) d
  ON d.entity_id = s.entity_id AND d.week_start = s.week_start AND d.cluster_id = s.cluster_id AND d.rn = 1
LEFT JOIN topics t ON t.topic_id = d.topic_id"""
    )
    q["storyline_articles"] = _with("SELECT * FROM week_articles WHERE cluster_id IS NOT NULL")
    q["keyword_string"] = _with("SELECT * FROM keyword_strings")
    q["score_parse"] = _with(
        """
SELECT entity_id, week_start, cluster_id, regexp_extract(item, '^(.*):[^:]*$', 1) AS keyword,
       max(abs(CAST(regexp_extract(item, ':([^:]*)$', 1) AS DOUBLE))) AS score
FROM (SELECT entity_id, week_start, cluster_id, unnest(string_split(keywords, ',')) AS item FROM keyword_strings)
GROUP BY ALL"""
    )
    q["keyword_chips"] = _with(
        """
SELECT entity_id, week_start, cluster_id, slot, keyword, round(score, 6) AS score, round(norm, 6) AS norm,
       CAST(floor(12 + 6 * norm) AS INTEGER) AS font_size, CAST(floor(20 + 60 * norm) AS INTEGER) AS bar_width
FROM (SELECT *, CASE WHEN hi = lo THEN 0.7e0 ELSE (score - lo) / (hi - lo) * 0.6e0 + 0.4e0 END AS norm
      FROM (SELECT *, min(score) OVER s AS lo, max(score) OVER s AS hi FROM shown
            WINDOW s AS (PARTITION BY entity_id, week_start, cluster_id)))""",
        """ranked AS (
  SELECT entity_id, week_start, cluster_id, keyword, abs(score) AS score,
         row_number() OVER (PARTITION BY entity_id, week_start, cluster_id ORDER BY abs(score) DESC, keyword) - 1 AS r,
         count(*) OVER (PARTITION BY entity_id, week_start, cluster_id) AS n
  FROM weekly_keywords)""",
        """shown AS (
  SELECT entity_id, week_start, cluster_id, keyword, score, CAST(r + 1 AS INTEGER) AS slot FROM ranked WHERE r < 5
  UNION ALL
  SELECT entity_id, week_start, cluster_id, keyword, score, CAST(least(n, 5) + r - n // 2 + 1 AS INTEGER)
  FROM ranked WHERE r >= n // 2 AND r < n // 2 + 5)""",
    )
    q["cluster_sizes"] = _with(
        """
SELECT entity_id, week_start, week_end, cluster_id, count(*) AS size FROM weekly_topic
WHERE cluster_id IS NOT NULL GROUP BY ALL"""
    )
    q["label_distribution"] = _with(
        """
SELECT label, coalesce(topic, 'Unknown') AS topic, n, round(n / sum(n) OVER (), 6) AS share
FROM (SELECT quality + 2 * toxic AS label, count(*) AS n FROM labels GROUP BY 1)
LEFT JOIN topics ON topic_id = label"""
    )

    # ---- entities and texts
    q["entity_match"] = _with(
        """
SELECT article_id, string_agg(name, '|' ORDER BY ord) AS teams FROM entity_counts GROUP BY article_id"""
    )
    q["entity_match_indexed"] = q["entity_match"]
    q["entity_counts"] = _with("SELECT article_id, entity_id, ord, name, cnt FROM entity_counts")
    assigned = """assigned AS (
  SELECT article_id, entity_id, name FROM (
    SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY cnt DESC, ord) AS rn FROM all_counts)
  WHERE rn = 1 OR cnt >= 5)"""
    q["entity_assign"] = _with("SELECT article_id, entity_id FROM assigned", assigned)
    q["known_entities"] = _with(
        """
SELECT article_id, string_agg(CAST(entity_id AS VARCHAR), '|' ORDER BY entity_id) AS ids
FROM article_entities GROUP BY article_id"""
    )
    q["training_extract"] = _with(
        """
SELECT a.article_id, o.name AS outlet, a.publication_date AS date, s.name AS team, a.title,
       md5(a.full_text) AS text_md5
FROM articles a JOIN outlets o ON o.id = a.outlet_id JOIN assigned s ON s.article_id = a.article_id
JOIN tokens t ON t.article_id = a.article_id
WHERE len(list_filter(tk, lambda x: x = 'was')) < 5
  AND a.article_id IN (SELECT article_id FROM article_entities)""",
        assigned,
    )
    q["training_file"] = _with(
        """
SELECT a.article_id, o.name AS outlet, a.publication_date AS date, s.name AS team,
       CAST(length(a.full_text) AS INTEGER) AS n_chars
FROM articles a JOIN outlets o ON o.id = a.outlet_id
JOIN tokens t ON t.article_id = a.article_id
JOIN (SELECT article_id, name FROM (
        SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY cnt DESC, ord) AS rn FROM entity_counts)
      WHERE rn = 1 OR cnt >= 3) s ON s.article_id = a.article_id
WHERE len(list_filter(tk, lambda x: x = 'women')) < 5"""
    )
    q["week_bucket"] = """
SELECT event_id, CAST(date_trunc('week', ts) AS DATE) AS week_start,
       CAST(date_trunc('week', ts) + INTERVAL 6 DAY AS DATE) AS week_end FROM events"""
    # Title and summary are matched, so the tokens of their joined text count here.
    q["feed_filter"] = _with(
        r"""
SELECT link, publication_date AS published_at, string_agg(name, '|' ORDER BY ord) AS teams, outlet
FROM (SELECT a.link, a.publication_date, o.name AS outlet, l.name, l.ord
      FROM articles a JOIN outlets o ON o.id = a.outlet_id
      JOIN lexicon l ON list_has_any(string_split(l.pattern, '|'),
        regexp_split_to_array(lower(title || ' ' || substr(full_text, 81)), '[^\p{L}\p{N}_]+'))
      WHERE publication_date BETWEEN TIMESTAMP '2025-06-02 00:00:00' AND TIMESTAMP '2025-07-20 23:00:00'
        AND (o.name <> 'SkySports' OR a.article_id % 2 = 0)
        AND full_text <> '' AND NOT contains(full_text, 'Nicht'))
GROUP BY link, publication_date, outlet"""
    )
    q["feed_files"] = _with(
        r"""
SELECT trim(regexp_replace(title, '\s+', ' ', 'g')) AS title,
       trim('a & b <c> ' || regexp_replace(substr(full_text, 81), '\s+', ' ', 'g')) AS summary, link,
       strftime(publication_date, '%a, %d %b %Y %H:%M:%S') || ' BST' AS published,
       CASE WHEN article_id % 2 = 0 THEN 'News Story' ELSE 'Live' END AS tags
FROM articles"""
    )
    # A cut-off title may end in an entity without its semicolon.
    unescape = (
        "regexp_replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'),"
        " '&#x27;', ''''), '&#39;', ''''), '&amp;?', '&', 'g')"
    )
    q["page_headings"] = f"""
SELECT page_id, {unescape.format("trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1))")} AS author,
       {unescape.format("trim(regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1))")} AS standfirst
FROM pages"""
    # An unclosed paragraph holds everything up to the end of the article.
    body = "regexp_replace(regexp_replace({}, '<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g')"
    q["entity_match_patterns"] = _with(
        """
SELECT t.article_id, p.entity_id, CAST(len(list_filter(tk, lambda x: regexp_full_match(x, p.pattern))) AS BIGINT) AS cnt
FROM tokens t CROSS JOIN patterns p WHERE cnt > 0""",
        f"patterns AS (SELECT * FROM (VALUES {_rows((100 + i, x) for i, x in enumerate(S.PATTERNS))}) t(entity_id, pattern))",
    )
    q["page_text"] = f"""
WITH parts AS (
  SELECT page_id, url, string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>') AS s FROM pages),
blocks AS (
  SELECT page_id, i, CASE WHEN contains(s[i], '</p>') THEN string_split(s[i], '</p>')[1]
                          ELSE array_to_string(s[i:], '') END AS block
  FROM parts, unnest(range(2, len(s) + 1)) t(i))
SELECT p.page_id, p.url, coalesce(b.body, '') AS body
FROM parts p LEFT JOIN (
  SELECT page_id, string_agg({unescape.format(body.format("block"))} || chr(10), '' ORDER BY i) AS body
  FROM blocks GROUP BY page_id) b ON b.page_id = p.page_id"""
    promo = ", ".join(f"'{x}'" for x in S.PROMO_LINES)
    q["page_promo_lines"] = rf"""
SELECT page_id, coalesce((
  SELECT string_agg({unescape.format("x")} || chr(10), '' ORDER BY i)
  FROM (SELECT unnest(a) AS x, unnest(range(len(a))) AS i FROM (
    SELECT regexp_extract_all(regexp_extract(p.html, '(?s)<nav>(.*?)</nav>', 1), '<a [^>]*>([^<]*)</a>', 1) AS a))
  WHERE x NOT IN ({promo})), '') AS body
FROM pages p"""
    q["ingest_articles"] = _with(
        rf"""
SELECT link, published_at, author, teams, standfirst AS summary, article, 'test' AS outlet
FROM (SELECT p.url AS link, TIMESTAMP '2025-06-01 00:00:00' + to_hours(CAST(p.page_id AS INTEGER)) AS published_at,
             h.author, h.standfirst, t.body AS article,
             (SELECT string_agg(name, '|' ORDER BY ord) FROM lexicon l
              WHERE list_has_any(string_split(l.pattern, '|'), regexp_split_to_array(
                lower(regexp_extract(p.html, '(?s)<title>(.*?)</title>', 1)), '[^\p{{L}}\p{{N}}_]+'))) AS teams
      FROM pages p
      JOIN (SELECT url, min_by(page_id, html) AS page_id FROM pages GROUP BY url) u ON u.url = p.url
      JOIN ({q["page_headings"]}) h ON h.page_id = u.page_id
      JOIN ({q["page_text"]}) t ON t.page_id = u.page_id
      JOIN (SELECT page_id FROM pages WHERE NOT contains(html, '<a href="/The">')
            AND NOT contains(html, '<a href="/En">')) x ON x.page_id = u.page_id)
WHERE teams IS NOT NULL AND published_at BETWEEN TIMESTAMP '2025-06-02 00:00:00' AND TIMESTAMP '2026-06-01 00:00:00'
  AND article <> '' AND NOT contains(article, 'Nicht')"""
    )
    q["page_exclusion"] = """
SELECT page_id, url FROM pages
WHERE NOT contains(html, '<a href="/The">') AND NOT contains(html, '<a href="/En">')"""

    # ---- backlogs, labels, merges
    q["topic_backlog"] = _with(
        """
SELECT w.entity_id, w.week_start, w.week_end, w.article_id, CAST(length(a.full_text) AS BIGINT) AS n_chars
FROM weekly_topic w JOIN articles a ON a.article_id = w.article_id WHERE w.topic_id IS NULL"""
    )
    q["cluster_backlog"] = _with(
        """
SELECT entity_id, week_start, week_end, article_id, topic_id FROM open_rows WHERE cluster_id IS NULL""",
        _BACKLOG,
    )
    q["cluster_backlog_weeks"] = _with(
        """
SELECT entity_id, week_start, week_end, article_id, topic_id FROM open_rows o
WHERE EXISTS (SELECT 1 FROM open_rows n WHERE n.cluster_id IS NULL AND n.entity_id = o.entity_id
              AND n.week_start = o.week_start)""",
        _BACKLOG,
    )
    q["label_merge"] = _with(
        """
SELECT w.entity_id, w.week_start, w.week_end, w.article_id, w.cluster_id,
       coalesce(g.topic, w.topic_id) AS topic_id,
       CASE WHEN g.topic IS NOT NULL THEN 1.0e0 END AS topic_probability,
       CASE WHEN g.topic IS NOT NULL THEN 'update' ELSE 'same' END AS _action
FROM weekly_topic w LEFT JOIN given g ON g.article_id = w.article_id AND g.entity_id = w.entity_id""",
        _LABELS,
    )
    q["label_orphans"] = _with(
        "SELECT DISTINCT article_id, entity_id FROM given WHERE article_id >= 1000000", _LABELS
    )
    q["label_file"] = _with("SELECT article_id, entity_id, topic FROM given", _LABELS)
    q["label_file_blanks"] = _with(
        """
SELECT article_id, entity_id, CASE WHEN article_id % 7 NOT IN (4, 5) THEN topic END AS topic
FROM given WHERE article_id % 7 NOT IN (1, 2, 3)""",
        _LABELS,
    )
    q["label_preview"] = _with(
        """
SELECT 'update' AS _action, entity_id, week_start, week_end, article_id, topic AS topic_id, NULL AS n
FROM (SELECT w.*, g.topic FROM weekly_topic w JOIN given g ON g.article_id = w.article_id AND g.entity_id = w.entity_id
      ORDER BY w.entity_id, week_start, week_end, w.article_id LIMIT 5)
UNION ALL SELECT CASE WHEN g.topic IS NULL THEN 'same' ELSE 'update' END, NULL, NULL, NULL, NULL, NULL, count(*)
FROM weekly_topic w LEFT JOIN given g ON g.article_id = w.article_id AND g.entity_id = w.entity_id GROUP BY 1""",
        _LABELS,
    )
    q["cluster_tables_merge"] = _with(
        """
SELECT coalesce(o.entity_id, n.entity_id) AS entity_id, coalesce(o.week_start, n.week_start) AS week_start,
       coalesce(o.cluster_id, n.moved) AS cluster_id, '' AS keyword, CAST(coalesce(n.size + 10, o.size) AS DOUBLE) AS value
FROM weekly_clusters o FULL JOIN (SELECT *, cluster_id + entity_id % 2 AS moved FROM weekly_clusters) n
  ON n.entity_id = o.entity_id AND n.week_start = o.week_start AND n.moved = o.cluster_id
UNION ALL
SELECT coalesce(o.entity_id, n.entity_id), coalesce(o.week_start, n.week_start), coalesce(o.cluster_id, n.moved),
       coalesce(o.keyword, n.keyword), CASE WHEN n.moved IS NULL THEN round(o.score, 6) ELSE 2.0e0 END
FROM weekly_keywords o FULL JOIN (SELECT *, cluster_id + entity_id % 2 AS moved FROM weekly_keywords) n
  ON n.entity_id = o.entity_id AND n.week_start = o.week_start AND n.moved = o.cluster_id AND n.keyword = o.keyword"""
    )
    q["saved_model_scores"] = """
SELECT vec_id AS article_id, true AS same, true AS usable, 'balanced' AS notes FROM embeddings"""
    q["stream_scores_as_batch"] = "SELECT vec_id AS article_id, true AS same FROM embeddings"
    q["topic_backlog_empty"] = _with(
        """
SELECT entity_id, week_start, week_end, article_id, cluster_id, coalesce(topic_id, 6) AS topic_id, topic_probability
FROM weekly_topic"""
    )
    q["people_gazetteer"] = _with(
        r"""
SELECT w.entity_id, w.week_start, w.cluster_id, g.keyword, count(*) AS cnt
FROM grams g JOIN weekly_topic w ON w.article_id = g.article_id
WHERE w.cluster_id IS NOT NULL AND g.keyword IN (
  SELECT array_to_string(tk[1:CAST(article_id % 3 + 1 AS INTEGER)], ' ') FROM tokens) GROUP BY ALL""",
        r"wordy AS (SELECT article_id, list_filter(tk, lambda x: NOT regexp_full_match(x, '\p{Nd}+')) AS w FROM tokens)",
        """grams AS (
  SELECT article_id, unnest(w) AS keyword FROM wordy
  UNION ALL SELECT article_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM wordy
  UNION ALL SELECT article_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  FROM wordy)""",
    )
    q["upsert_articles"] = _with(
        """
SELECT i.id, f.link, l.title, l.summary, f.publication_date, f.outlet_id, a.id AS author_id,
       md5(f.full_text) AS full_text
FROM first_rows f JOIN last_rows l ON l.link = f.link JOIN article_ids i ON i.link = f.link
JOIN author_ids a ON a.name = f.author""",
        *_SCRAPED,
    )
    q["upsert_dimensions"] = _with(
        """
SELECT 'author' AS dim, id, name FROM author_ids
UNION ALL SELECT 'outlet', CAST(id AS BIGINT), name FROM outlets
UNION ALL SELECT 'team', CAST(id AS BIGINT), name
FROM (VALUES (1, 'Arsenal'), (2, 'Chelsea'), (3, 'Liverpool')) t(id, name)""",
        *_SCRAPED,
    )
    q["upsert_article_teams"] = _with(
        """
SELECT id AS article_id, 1 AS team_id FROM article_ids
UNION ALL SELECT id, 2 FROM known
UNION ALL SELECT i.id, 3 FROM article_ids i JOIN last_rows l ON l.link = i.link WHERE l.summary = 's2'""",
        *_SCRAPED,
    )
    q["keyed_article_merge"] = _with(
        """
SELECT f.link, l.title, l.summary, f.publication_date, md5(f.full_text) AS full_text
FROM first_rows f JOIN last_rows l ON l.link = f.link""",
        *_SCRAPED,
    )
    q["stream_article_refresh"] = _with(
        """
SELECT f.link, f.publication_date AS published_at, o.name AS outlet, f.author, l.title, l.summary,
       md5(f.full_text) AS article
FROM first_rows f JOIN last_rows l ON l.link = f.link JOIN outlets o ON o.id = f.outlet_id""",
        *_SCRAPED,
    )
    q["stream_label_arrivals"] = _with(
        """
SELECT g.article_id, g.entity_id, g.topic, CASE WHEN g.article_id < 1000000 THEN 'label' ELSE 'orphan' END AS kind
FROM given g
UNION ALL SELECT ae.article_id, ae.entity_id, NULL, 'open' FROM article_entities ae
WHERE ae.article_id NOT IN (SELECT doc_id FROM labels)""",
        _LABELS,
    )
    q["ingest_rejects"] = _with(
        """
SELECT CASE WHEN id % 11 = 0 THEN 'link' ELSE 'outlet' END AS kind, CASE WHEN id % 11 <> 0 THEN link END AS key,
       CASE WHEN id % 5 = 0 THEN 'ITV' ELSE outlet END AS name
FROM sent WHERE id % 11 = 0 OR id % 5 = 0
UNION ALL SELECT 'team', link, 'Everton' FROM sent WHERE author = 'fr' AND id % 11 <> 0 AND id % 5 <> 0
UNION ALL SELECT 'date', link, 'soon' FROM articles WHERE article_id % 13 = 0
UNION ALL SELECT 'articles', link, CAST(outlet_id AS VARCHAR) FROM first_rows
  WHERE lang = 'en' OR (article_id % 11 <> 0 AND article_id % 5 <> 0)
UNION ALL SELECT DISTINCT 'article_teams', link, CAST(team AS VARCHAR) FROM (
  SELECT link, 1 AS team FROM known
  UNION ALL SELECT link, unnest(teams) FROM sent WHERE id % 11 <> 0 AND id % 5 <> 0)
UNION ALL SELECT 'outlets', CAST(id AS VARCHAR), name FROM outlets
UNION ALL SELECT 'teams', CAST(id AS VARCHAR), name
  FROM (VALUES (1, 'Arsenal'), (2, 'Chelsea'), (3, 'Liverpool')) t(id, name)""",
        *_SCRAPED,
        """sent AS (
  SELECT article_id AS id, link, o.name AS outlet, author,
         CASE WHEN lang = 'en' THEN [1, 2] ELSE [1] END AS teams
  FROM first_rows f JOIN outlets o ON o.id = f.outlet_id
  UNION ALL
  SELECT f.article_id, f.link, 'BBC', '', [3] FROM first_rows f JOIN labels l ON l.doc_id = f.article_id)""",
    )
    q["bridge_insert_ignore"] = _with("SELECT article_id, entity_id FROM article_entities")
    q["cluster_column_merge"] = _with(
        """
SELECT entity_id, week_start, week_end, article_id, CAST(article_id % 3 AS INTEGER) AS cluster_id, topic_id,
       topic_probability FROM weekly_topic"""
    )
    q["delete_cascade"] = _with(
        """
SELECT k.entity_id, k.week_start, k.cluster_id, keyword, round(score, 6) AS score
FROM weekly_keywords k JOIN weekly_clusters c
  ON c.entity_id = k.entity_id AND c.week_start = k.week_start AND c.cluster_id = k.cluster_id
WHERE c.size >= 3"""
    )
    q["delete_set_null"] = """
SELECT o_orderkey, CASE WHEN c.c_custkey IS NULL THEN o_custkey END AS o_custkey
FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_acctbal < 0"""
    q["published_tables"] = _with(
        """
SELECT w.entity_id, w.week_start, w.cluster_id, article_id, 6 AS topic_id, size
FROM weekly_topic w JOIN weekly_clusters c
  ON c.entity_id = w.entity_id AND c.week_start = w.week_start AND c.cluster_id = w.cluster_id"""
    )
    q["storyline_export"] = _with(
        """
SELECT entity_id, week_start, article_id, topic_id, link, publication_date, outlet, cluster_id
FROM week_articles WHERE cluster_id IS NOT NULL"""
    )
    q["audit_constraints"] = _with(
        """
SELECT 'documents.text' AS check_name, md5(text) AS key, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1
UNION ALL SELECT 'lineitem.key', l_orderkey || '|' || l_linenumber, count(*) FROM lineitem
  GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'documents.label', CAST(doc_id AS VARCHAR), 1 FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'orders.part', CAST(o_custkey AS VARCHAR), count(*) FROM orders
  WHERE o_custkey NOT IN (SELECT p_partkey FROM part) GROUP BY o_custkey
UNION ALL SELECT 'weekly_topic.topic', concat_ws('|', entity_id, week_start, week_end, article_id), 1
  FROM weekly_topic WHERE topic_id IS NULL
UNION ALL SELECT 'documents.text', CAST(doc_id AS VARCHAR), length(text) FROM documents WHERE length(text) > 5000
UNION ALL SELECT 'documents.lang', lang, count(*) FROM documents WHERE lang NOT IN ('en', 'fr') GROUP BY lang
UNION ALL SELECT 'events.type', event_type, count(*) FROM events
  WHERE event_type NOT IN ('view', 'click') GROUP BY event_type"""
    )

    cluster_key = "concat_ws('|', k.entity_id, k.week_start, CAST(k.week_start + INTERVAL 6 DAY AS DATE), k.cluster_id)"
    q["storyline_audit"] = _with(
        f"""
SELECT 'authors.name' AS check_name, CAST(ascii('d') * 256 + ascii('e') AS VARCHAR) AS key, CAST(1 AS BIGINT) AS n
  FROM documents WHERE lang = 'de' GROUP BY lang
UNION ALL SELECT 'teams.name', name, 1 FROM lexicon
UNION ALL SELECT 'articles.link', CAST(article_id AS VARCHAR), CASE WHEN article_id % 50 = 0 THEN 600 ELSE 1 END
  FROM stored WHERE article_id % 50 = 0 OR article_id % 90 = 7
UNION ALL SELECT 'articles.outlet', '9', count(*) FROM stored WHERE article_id % 40 = 1 HAVING count(*) > 0
UNION ALL SELECT 'article_teams.article', CAST(article_id AS VARCHAR), count(*) FROM entity_counts
  WHERE cnt >= 2 AND article_id % 30 = 0 GROUP BY article_id
UNION ALL SELECT 'weekly_topic.pair', e.entity_id || '|' || e.article_id, count(*) FROM weekly_topic w
  JOIN entity_counts e ON e.article_id = w.article_id AND e.entity_id = w.entity_id WHERE e.cnt = 1 GROUP BY ALL
UNION ALL SELECT 'weekly_keywords.cluster', {cluster_key}, count(*) FROM weekly_keywords k JOIN weekly_clusters c
  ON c.entity_id = k.entity_id AND c.week_start = k.week_start AND c.cluster_id = k.cluster_id
  WHERE c.size < 3 GROUP BY ALL
UNION ALL SELECT 'weekly_keywords.score', {cluster_key}, 1 FROM weekly_keywords k WHERE length(k.keyword) = 9""",
        "stored AS (SELECT * FROM articles WHERE article_id % 30 <> 0)",
    )

    # ---- keywords
    q["keyword_ctfidf"] = _with(
        _scored("grams"),
        *_PHRASES,
        """grams AS (
  SELECT w.entity_id, w.week_start, w.cluster_id, p.keyword, count(*) AS cnt
  FROM weekly_topic w JOIN phrases p ON p.article_id = w.article_id
  WHERE w.cluster_id IS NOT NULL GROUP BY ALL)""",
    )
    q["people_keywords"] = _with(
        _scored("people"),
        _NAMES,
        """people AS (
  SELECT w.entity_id, w.week_start, w.cluster_id, p.keyword, count(*) AS cnt
  FROM weekly_topic w JOIN names p ON p.article_id = w.article_id
  WHERE w.cluster_id IS NOT NULL GROUP BY ALL)""",
    )
    unit, word, ends = people.UNIT.replace("'", "''"), people.NAME_WORD.replace("'", "''"), people.IS_RUN.replace("'", "''")
    q["people_names"] = _with(
        """
SELECT w.entity_id, w.week_start, w.cluster_id, n.keyword, count(*) AS cnt
FROM weekly_topic w JOIN units u ON u.article_id = w.article_id
JOIN (SELECT unit, unnest(string_split(t, '|')[2:]) AS keyword FROM named) n ON n.unit = u.unit
WHERE w.cluster_id IS NOT NULL GROUP BY ALL""",
        f"""units AS (
  SELECT article_id, unnest(regexp_extract_all('.' || coalesce(full_text, ''), '{unit}')) AS unit FROM articles)""",
        "counted AS (SELECT unit, count(*) AS n FROM units GROUP BY ALL)",
        f"""unit_words AS (
  SELECT unit, n, regexp_matches(unit, '{ends}') AS run, regexp_matches(unit, '{people.BEGINS}') AS begins,
         lower(unnest(ws)) AS word, unnest(range(len(ws))) AS pos
  FROM (SELECT *, regexp_extract_all(unit, '{word}') AS ws FROM counted))""",
        """name_words AS (
  SELECT word FROM unit_words GROUP BY ALL
  HAVING coalesce(sum(n) FILTER (run AND NOT (begins AND pos = 0)), 0) > coalesce(sum(n) FILTER (NOT run), 0))""",
        """known AS (
  SELECT u.unit, u.n, u.pos, u.word, row_number() OVER w AS r,
         CASE WHEN lead(u.pos) OVER w = u.pos + 1 THEN lead(u.word) OVER w END AS after
  FROM unit_words u JOIN name_words USING (word) WHERE u.run WINDOW w AS (PARTITION BY u.unit ORDER BY u.pos))""",
        "alone AS (SELECT word, sum(n) AS c FROM known GROUP BY ALL)",
        """linked AS (
  SELECT k.unit, k.r, k.word, greatest(coalesce(1000 * p.both_n // least(a.c, b.c) - 500, 0), 0) AS link
  FROM known k LEFT JOIN (SELECT word, after, sum(n) AS both_n FROM known WHERE after IS NOT NULL GROUP BY ALL) p
    ON p.word = k.word AND p.after = k.after
  LEFT JOIN alone a ON a.word = k.word LEFT JOIN alone b ON b.word = k.after)""",
        """steps AS (
  SELECT *, lag(word) OVER w AS w1, lag(word, 2) OVER w AS w2, coalesce(lag(link) OVER w, 0) AS l1,
         coalesce(lag(link, 2) OVER w, 0) AS l2, count(*) OVER (PARTITION BY unit) AS m
  FROM linked WINDOW w AS (PARTITION BY unit ORDER BY r))""",
        """walk AS (
  SELECT unit, CAST(0 AS BIGINT) AS r, CAST(0 AS HUGEINT) AS b1, CAST(0 AS HUGEINT) AS b2, CAST(0 AS HUGEINT) AS b3,
         '' AS t1, '' AS t2, '' AS t3 FROM steps WHERE r = 1
  UNION ALL
  SELECT unit, r, CAST(greatest(c1, c2, c3) AS HUGEINT), b1, b2,
         CASE WHEN c1 >= c2 AND c1 >= c3 THEN t1 || '|' || word
              WHEN c2 >= c3 THEN t2 || '|' || w1 || ' ' || word ELSE t3 || '|' || w2 || ' ' || w1 || ' ' || word END, t1, t2
  FROM (SELECT s.unit, s.r, s.word, s.w1, s.w2, v.b1, v.b2, v.t1, v.t2, v.t3, v.b1 AS c1,
               CASE WHEN s.l1 > 0 THEN v.b2 + s.l1 ELSE -1 END AS c2,
               CASE WHEN s.l1 > 0 AND s.l2 > 0 THEN v.b3 + s.l1 + s.l2 ELSE -1 END AS c3
        FROM walk v JOIN steps s ON s.unit = v.unit AND s.r = v.r + 1))""",
        "named AS (SELECT v.unit, v.t1 AS t FROM walk v JOIN steps s ON s.unit = v.unit AND s.r = v.r WHERE s.r = s.m)",
    )
    q["article_vectors"] = _with(
        r"""
SELECT article_id, 64 AS entries, CASE WHEN regexp_matches(full_text, '[\p{L}\p{N}_]') THEN 1.0 ELSE 0.0 END AS norm
FROM articles"""
    )
    q["keyword_dedup"] = _with(
        """
SELECT entity_id, week_start, cluster_id, keyword, round(score, 6) AS score FROM own k
WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.entity_id = k.entity_id AND o.week_start = k.week_start
                  AND o.cluster_id = k.cluster_id AND o.keyword <> k.keyword AND contains(o.keyword, k.keyword))""",
        """own AS (
  SELECT k.* FROM weekly_keywords k JOIN lexicon l ON l.entity_id = k.entity_id
  WHERE NOT list_contains(string_split(l.pattern, '|'), k.keyword))""",
    )

    q["keyword_centroid"] = _with(
        """
SELECT entity_id, week_start, cluster_id, keyword,
       round(coalesce(sum(p * c) / nullif(sqrt(sum(p * p) * sum(c * c)), 0), 0), 5) AS score
FROM (SELECT h.entity_id, h.week_start, h.cluster_id, h.keyword, h.i, avg(h.v) AS p, any_value(c.v) AS c
      FROM (SELECT h.*, d.i, d.v FROM held h JOIN dims d ON d.article_id = h.article_id) h
      JOIN (SELECT w.entity_id, w.week_start, w.cluster_id, d.i, avg(d.v) AS v
            FROM weekly_topic w JOIN dims d ON d.article_id = w.article_id
            WHERE w.cluster_id IS NOT NULL GROUP BY ALL) c
        ON c.entity_id = h.entity_id AND c.week_start = h.week_start AND c.cluster_id = h.cluster_id AND c.i = h.i
      GROUP BY ALL)
GROUP BY ALL""",
        """dims AS (
  SELECT vec_id AS article_id, unnest(range(1, len(embedding) + 1)) AS i,
         CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)""",
        r"""held AS (
  SELECT DISTINCT k.entity_id, k.week_start, k.cluster_id, k.keyword, w.article_id
  FROM weekly_keywords k
  JOIN weekly_topic w ON w.entity_id = k.entity_id AND w.week_start = k.week_start AND w.cluster_id = k.cluster_id
  JOIN tokens t ON t.article_id = w.article_id AND list_contains(t.tk, k.keyword)
  WHERE w.article_id IN (SELECT vec_id FROM embeddings) AND NOT regexp_full_match(k.keyword, '\p{Nd}+'))""",
    )

    # ---- clusters
    q["elbow_k"] = _with(
        """
SELECT entity_id, CAST(k AS INTEGER) AS best_k FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY off DESC, k) AS rn
  FROM (SELECT entity_id, k, CASE WHEN d <= 1e-9 * abs(i0 - i1) THEN 0.0e0 ELSE d END AS off
        FROM (SELECT *, abs(inertia - (i0 - (k - k0) * ((i0 - i1) / greatest(k1 - k0, 1)))) AS d
              FROM (SELECT *, min(k) OVER e AS k0, max(k) OVER e AS k1,
                           arg_min(inertia, k) OVER e AS i0, arg_max(inertia, k) OVER e AS i1
                    FROM curve WINDOW e AS (PARTITION BY entity_id)))))
WHERE rn = 1""",
        """ordered AS (
  SELECT entity_id, week_start, count(*) AS n,
         row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, week_start) AS k
  FROM weekly_topic GROUP BY entity_id, week_start)""",
        """curve AS (
  SELECT * FROM (SELECT entity_id, k, CAST(coalesce(sum(n) OVER (PARTITION BY entity_id ORDER BY k
           ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS DOUBLE) AS inertia FROM ordered)
  WHERE k >= 2)""",
    )

    q["kmeans_sweep"] = _with(
        """
SELECT entity_id, week_start, k, round(sum(dist), 4) AS inertia FROM placed GROUP BY entity_id, week_start, k""",
        *_KMEANS,
    )
    q["kmeans_sweep_chunked"] = q["kmeans_sweep"]
    q["weekly_clusters"] = _with(
        """
SELECT p.entity_id, p.week_start, p.article_id, CAST(coalesce(l.c, 0) AS INTEGER) AS cluster_id
FROM points p LEFT JOIN best b ON b.entity_id = p.entity_id AND b.week_start = p.week_start
LEFT JOIN placed l ON l.entity_id = p.entity_id AND l.week_start = p.week_start AND l.article_id = p.article_id
  AND l.k = b.k""",
        *_KMEANS,
        *_BEST,
    )

    q["weekly_clusters_chunked"] = q["weekly_clusters"]

    # The whole weekly job: touched weeks get new clusters and keywords, others stay.
    def best_ten(name: str, phrases: str) -> list[str]:
        return [
            f"""{name}_counts AS (
  SELECT m.entity_id, m.week_start, m.cluster_id, p.keyword, count(*) AS cnt
  FROM members m JOIN {phrases} p ON p.article_id = m.article_id GROUP BY ALL)""",
            f"""{name}_best AS (
  SELECT entity_id, week_start, cluster_id, keyword, score FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id, week_start, cluster_id ORDER BY score DESC, keyword) AS rank
    FROM (SELECT c.*, CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY entity_id, week_start, cluster_id)
                 * ln(1.0e0 + (SELECT avg(n) FROM (SELECT sum(cnt) AS n FROM {name}_counts
                                                 GROUP BY entity_id, week_start, cluster_id))
                      / sum(cnt) OVER (PARTITION BY keyword)) AS score
          FROM {name}_counts c)) WHERE rank <= 10)""",
        ]

    q["weekly_storylines"] = _with(
        """
SELECT k.entity_id, k.week_start, CAST(k.week_start + INTERVAL 6 DAY AS DATE) AS week_end, k.cluster_id, k.keyword,
       round(k.score, 6) AS score, s.size
FROM (SELECT * FROM cleaned c
      WHERE NOT EXISTS (SELECT 1 FROM cleaned o WHERE o.entity_id = c.entity_id AND o.week_start = c.week_start
        AND o.cluster_id = c.cluster_id AND o.keyword <> c.keyword AND contains(o.keyword, c.keyword))) k
JOIN (SELECT entity_id, week_start, cluster_id, count(*) AS size FROM members GROUP BY ALL) s
  ON s.entity_id = k.entity_id AND s.week_start = k.week_start AND s.cluster_id = k.cluster_id
UNION ALL
SELECT k.entity_id, k.week_start, CAST(k.week_start + INTERVAL 6 DAY AS DATE), k.cluster_id, k.keyword,
       round(k.score, 6), c.size
FROM weekly_keywords k JOIN weekly_clusters c
  ON c.entity_id = k.entity_id AND c.week_start = k.week_start AND c.cluster_id = k.cluster_id
WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.entity_id = k.entity_id AND t.week_start = k.week_start)""",
        *_KMEANS,
        *_BEST,
        *_PHRASES,
        _NAMES,
        """touched AS (
  SELECT DISTINCT w.entity_id, w.week_start FROM weekly_topic w JOIN embeddings e ON e.vec_id = w.article_id
  WHERE w.cluster_id IS NULL AND w.week_end < DATE '2025-08-01')""",
        """members AS (
  SELECT p.entity_id, p.week_start, p.article_id, CAST(coalesce(l.c, 0) AS INTEGER) AS cluster_id
  FROM points p JOIN touched t ON t.entity_id = p.entity_id AND t.week_start = p.week_start
  LEFT JOIN best b ON b.entity_id = p.entity_id AND b.week_start = p.week_start
  LEFT JOIN placed l ON l.entity_id = p.entity_id AND l.week_start = p.week_start
    AND l.article_id = p.article_id AND l.k = b.k)""",
        *best_ten("general", "phrases"),
        *best_ten("person", "names"),
        r"""cleaned AS (
  SELECT k.entity_id, k.week_start, k.cluster_id, k.keyword, max(k.score) AS score
  FROM (SELECT * FROM general_best UNION ALL SELECT * FROM person_best) k
  JOIN lexicon l ON l.entity_id = k.entity_id
  WHERE NOT list_has_any(string_split(l.pattern, '|'), regexp_split_to_array(k.keyword, '[^\p{L}\p{N}_]+'))
  GROUP BY ALL)""",
    )

    # ---- topic models
    q["class_weights"] = """
SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * CAST(n AS DOUBLE)), 6) AS weight
FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)"""
    q["stratified_split"] = """
SELECT article_id, label, CASE WHEN pos <= floor(n * 0.3e0 + 0.5e0) THEN 'test' ELSE 'train' END AS part
FROM (SELECT vec_id AS article_id, label, count(*) OVER (PARTITION BY label) AS n,
             row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id)) AS pos FROM embeddings)"""
    q["stratified_folds"] = """
SELECT vec_id AS article_id, label,
       CAST((row_number() OVER (PARTITION BY label ORDER BY md5('1-1|' || vec_id)) - 1) % 10 AS INTEGER) AS fold
FROM embeddings"""
    q["confusion_matrix"] = _with(
        """
SELECT CAST(a.c AS INTEGER) AS label, CAST(b.c AS INTEGER) AS prediction, coalesce(n, 0) AS n,
       round(coalesce(n / total, 0), 6) AS share
FROM range(5) a(c) CROSS JOIN range(5) b(c)
LEFT JOIN (SELECT label, prediction, count(*) AS n FROM judged GROUP BY ALL) j
  ON j.label = a.c AND j.prediction = b.c
LEFT JOIN (SELECT label, count(*) AS total FROM judged GROUP BY ALL) t ON t.label = a.c""",
        _JUDGED,
    )
    q["penalty_grid_optimality"] = """
SELECT CAST(p AS DOUBLE) AS penalty, 30 AS fits, 30 AS solved, 3 * (SELECT count(*) FROM embeddings) AS rows_scored
FROM (VALUES (0.0), (0.00005), (0.0001), (0.0005), (0.001), (0.005), (0.01), (0.05), (0.1), (0.5), (1.0)) t(p)"""
    examples = """
SELECT quality + 2 * toxic AS label, count(*) AS n FROM labels JOIN embeddings ON doc_id = vec_id GROUP BY 1"""
    q["support_vector_optimality"] = f"""
SELECT a.label AS first, b.label AS second, a.n + b.n AS rows, 0e0 AS residual
FROM ({examples}) a JOIN ({examples}) b ON a.label < b.label"""
    q["boosting_fit"] = f"""
SELECT 100 AS rounds, count(*) AS classes, 100 * count(*) AS trees, true AS falls, CAST(sum(n) AS BIGINT) AS rows
FROM ({examples})"""
    q["model_scores"] = _with(
        """
SELECT CAST(sum(n) AS BIGINT) AS rows, round(sum(hit) / sum(n), 6) AS accuracy,
       round(avg(hit / n), 6) AS balanced_accuracy
FROM (SELECT label, count(*) AS n, count(*) FILTER (WHERE label = prediction) AS hit FROM judged GROUP BY label)""",
        _JUDGED,
    )

    # ---- streams: closed weeks and final tables equal the batch results
    q["stream_week_counts"] = """
SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week_start,
       CAST(date_trunc('week', ts) + INTERVAL 6 DAY AS DATE) AS week_end, count(*) AS cnt
FROM events
WHERE date_trunc('week', ts) + INTERVAL 8 DAY <= (SELECT max(ts) FROM events)
GROUP BY ALL"""
    q["stream_first_copies"] = "SELECT DISTINCT user_id || '/' || event_type AS link FROM events"
    q["stream_topic_merge"] = _with(
        """
SELECT w.entity_id, w.week_start, w.week_end, w.article_id, w.cluster_id, l.quality AS topic_id,
       CASE WHEN l.doc_id IS NOT NULL THEN 1.0e0 END AS topic_probability
FROM weekly_topic w LEFT JOIN labels l ON l.doc_id = w.article_id"""
    )
    return q
