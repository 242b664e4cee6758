"""DuckDB SQL for the queries that SQL can express."""

from .line_dedup import NEWLINE
from .quality_rules import COUNTS, CUTOFFS, LANGUAGES, OTHER, PROPOSING, SIGNALS, RiskControlledRules
from .url_filter import ALPHABET, OTHER as OTHER_SYMBOL, RULES, STEP, SYMBOLS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality_rules() -> str:
    """Counts, cutoffs proposed by one part of the labels, nested rule sets tested exactly on the other, and verdicts."""
    r = RiskControlledRules()
    signals = ", ".join(f"({k}, '{s}')" for k, s in enumerate(SIGNALS))
    cuts = ", ".join(f"({c})" for c in CUTOFFS)
    value = lambda col: "CASE " + " ".join(f"WHEN signal = '{s}' THEN {SIGNALS[s][col]}" for s in SIGNALS) + " END"
    stratum = f"CASE WHEN lang IN ({', '.join(repr(x) for x in LANGUAGES)}) THEN lang ELSE '{OTHER}' END"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w, string_split(coalesce(text, ''), chr({NEWLINE})) AS l, row_number() OVER () AS rid FROM documents),
win AS (SELECT rid, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3),
grams AS (SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM win),
often AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS k FROM grams) WHERE k > 1),
rep AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM often) GROUP BY 1),
c AS (SELECT d.rid, doc_id, lang, md5(text) AS digest, {stratum} AS stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, length(text) - length(replace(text, '!', '')) AS n_shouts,
  len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines
  FROM d LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed FROM c),
known AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
sig AS (SELECT * FROM (VALUES {signals}) AS t(k, signal)), cut AS (SELECT * FROM (VALUES {cuts}) AS t(cutoff)),
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY digest, lang NULLS FIRST) AS turn FROM f JOIN known USING (doc_id) WHERE NOT base_failed),
draws AS (SELECT stratum, digest AS rid, min(good) AS good, {', '.join(f'min({c}) AS {c}' for c in COUNTS)} FROM one WHERE turn = 1 GROUP BY 1, 2),
lab AS (SELECT rid, stratum, signal, sig.k AS turn, good, rid[1] IN ({', '.join(repr(x) for x in PROPOSING)}) AS proposes, {value(0)} AS what, {value(1)} AS whole FROM draws, sig),
tally AS (SELECT stratum, signal, turn, cutoff, count(*) FILTER (NOT good AND whole > 0 AND 1000 * what >= cutoff * whole) - {r.cost} * count(*) FILTER (good AND whole > 0 AND 1000 * what >= cutoff * whole) AS worth FROM lab, cut WHERE proposes GROUP BY 1, 2, 3, 4),
chosen AS (SELECT stratum, signal, turn, max(worth) AS worth, arg_max(cutoff, worth * 10000 + cutoff) AS cutoff FROM tally WHERE worth > 0 GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY worth DESC, turn) AS step FROM chosen),
hit AS (SELECT rid, stratum, min(step) AS step FROM lab JOIN ranked USING (stratum, signal) WHERE good AND NOT proposes AND whole > 0 AND 1000 * what >= cutoff * whole GROUP BY 1, 2),
goods AS (SELECT stratum, count(DISTINCT rid) AS n FROM lab WHERE good AND NOT proposes GROUP BY 1),
counts AS (SELECT ranked.*, coalesce(n, 0) AS n, (SELECT count(*) FROM hit WHERE hit.stratum = ranked.stratum AND hit.step <= ranked.step) AS k FROM ranked LEFT JOIN goods USING (stratum)),
tested AS (SELECT *, CASE WHEN k >= n THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1.0) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1.0) END - lgamma(n - j + 1.0) + j * ln({r.total_risk}) + (n - j) * ln(1 - {r.total_risk}))) FROM (SELECT unnest(range(0, k + 1))::DOUBLE AS j)) END AS p FROM counts),
unsafe AS (SELECT stratum, min(step) AS stop FROM tested WHERE p > {r.level!r} GROUP BY 1),
best AS (SELECT stratum, signal, cutoff FROM tested LEFT JOIN unsafe USING (stratum) WHERE stop IS NULL OR step < stop),
bad AS (SELECT DISTINCT rid FROM (SELECT rid, stratum, signal, {value(0)} AS what, {value(1)} AS whole FROM f, sig) JOIN best USING (stratum, signal) WHERE whole > 0 AND 1000 * what >= cutoff * whole)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM f"""


def line_dedup(percent: float = 5, min_pages: int = 5) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, string_split(coalesce(text, ''), chr({NEWLINE})) AS l FROM documents),
x AS (SELECT rid, doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
total AS (SELECT source, count(*) AS n FROM d GROUP BY 1),
bad AS (SELECT source, line, true AS goes FROM (SELECT source, line, count(DISTINCT rid) AS k FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) JOIN total USING (source) WHERE k >= 2 AND (k >= {min_pages} OR k * 2 > n) AND k * 100 > {percent} * n)
SELECT doc_id, count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]'))::BIGINT AS n_lines, count(*) FILTER (goes)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr({NEWLINE}) ORDER BY pos) FILTER (goes IS NULL), '')) AS kept_sha256
FROM x LEFT JOIN bad USING (source, line) GROUP BY rid, doc_id"""


def source_audit(min_docs: int = 10, most: int = 10) -> str:
    """Shares of all kept terms in all groups of a language, pair by pair."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM x GROUP BY 1, 2 HAVING count(DISTINCT rid) >= {min_docs}),
c AS (SELECT lang, source, term, count(*) AS n FROM x JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
total AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY 1, 2),
p AS (SELECT k.lang, t.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v) AS p FROM kept k JOIN total t ON k.lang = t.lang JOIN v ON k.lang = v.lang LEFT JOIN c ON c.lang = k.lang AND c.source = t.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2) JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM total GROUP BY 1) USING (lang) JOIN v USING (lang)),
both_ways AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN both_ways w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)) WHERE part = 'pair' OR rank <= {most}"""


def url_filter(lost_percent: int = 5) -> str:
    """Rules, Witten-Bell models over folded symbols, and the calibrated cutoff."""
    rules = ", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = []
    for k in ("allow", "block"):
        p = f"(1.0::DOUBLE / {SYMBOLS})"
        for ctx, count, seen, kinds in (("0", "n0", "all0", "kinds0"), ("1", "n1", "all1", "kinds1"), ("2", "n2", "all2", "kinds2")):
            p = f"(CASE WHEN coalesce({k}_{seen}, 0) > 0 THEN (coalesce({k}_{count}, 0) + {k}_{kinds} * {p}) / ({k}_{seen} + {k}_{kinds}) ELSE {p} END)"
        parts.append(f"ln({p})")
    joins = " ".join(
        f"""LEFT JOIN (SELECT a, b, c, n AS {k}_n2 FROM cnt WHERE kind = '{k}') USING (a, b, c) LEFT JOIN (SELECT a, b, sum(n) AS {k}_all2, count(*) AS {k}_kinds2 FROM cnt WHERE kind = '{k}' GROUP BY 1, 2) USING (a, b)
LEFT JOIN (SELECT b, c, n AS {k}_n1 FROM one WHERE kind = '{k}') USING (b, c) LEFT JOIN (SELECT b, sum(n) AS {k}_all1, count(*) AS {k}_kinds1 FROM one WHERE kind = '{k}' GROUP BY 1) USING (b)
LEFT JOIN (SELECT c, n AS {k}_n0 FROM zero WHERE kind = '{k}') USING (c) CROSS JOIN (SELECT sum(n) AS {k}_all0, count(*) AS {k}_kinds0 FROM zero WHERE kind = '{k}')"""
        for k in ("allow", "block")
    )
    return rf"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rid, page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules AS (SELECT * FROM (VALUES {rules}) AS t(rule, rhost, rpath, verdict)),
fit AS (SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS by_rule FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1),
j AS (SELECT h.*, rule, by_rule, regexp_replace(translate(url, '{upper}', '{lower}'), '[0-9]', '0', 'g') AS s, md5(url)[1] IN ('0', '1', '2', '3') AS kept_back FROM h LEFT JOIN fit USING (rid)),
k AS (SELECT *, list_concat([0, 0], list_transform(CASE WHEN s = '' THEN [] ELSE string_split(s, '') END, lambda x: CASE WHEN strpos('{ALPHABET}', x) > 0 THEN strpos('{ALPHABET}', x) ELSE {OTHER_SYMBOL} END), [0]) AS codes FROM j),
g AS (SELECT rid, by_rule, kept_back, pos, codes[pos - 2] AS a, codes[pos - 1] AS b, codes[pos] AS c FROM (SELECT *, unnest(range(3, len(codes) + 1)) AS pos FROM k)),
cnt AS (SELECT by_rule AS kind, a, b, c, count(*) AS n FROM g WHERE by_rule IS NOT NULL AND NOT kept_back GROUP BY 1, 2, 3, 4),
one AS (SELECT kind, b, c, sum(n) AS n FROM cnt GROUP BY 1, 2, 3), zero AS (SELECT kind, c, sum(n) AS n FROM one GROUP BY 1, 2),
kinds AS (SELECT count(DISTINCT kind) AS kinds FROM cnt),
model AS (SELECT a, b, c, {parts[0]} - {parts[1]} AS log_ratio FROM (SELECT DISTINCT a, b, c FROM g) {joins}),
score AS (SELECT rid, floor(sum(log_ratio) / count(*) * {STEP})::BIGINT AS score FROM g JOIN model USING (a, b, c) GROUP BY 1),
good AS (SELECT score FROM score JOIN k USING (rid) WHERE by_rule = 'allow' AND kept_back),
cutoff AS (SELECT max(score) AS cutoff FROM (SELECT score, (SELECT count(*) FROM good y WHERE y.score < x.score) AS below FROM (SELECT DISTINCT score FROM good) x) WHERE below * 100 <= {lost_percent} * (SELECT count(*) FROM good))
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN kinds = 2 AND score < cutoff THEN 'block' ELSE 'allow' END) AS verdict FROM k JOIN score USING (rid), kinds, cutoff"""
