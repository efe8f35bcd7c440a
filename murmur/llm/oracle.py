"""DuckDB SQL of the queries that SQL expresses: mixing, dated URL lists and license scans."""

from __future__ import annotations

from . import licenses, mixing, url_lists


def _hex(text: str, digits: int) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"


def _uniform(text: str) -> str:
    return f"({_hex(text, 13)} / {float(1 << 52)!r})"


def source_mixing() -> str:
    name = "name || ':' || ordinal"
    return f"""WITH sized AS (SELECT source, sum(greatest(coalesce(length(text), 1), 1)) AS size FROM documents GROUP BY source),
whole AS (SELECT sum(size) AS size, sum(pow(size, {mixing.TEMPERATURE})) AS weight FROM sized),
rates AS (SELECT source, pow(s.size, {mixing.TEMPERATURE}) / s.size * ({mixing.EPOCHS} * w.size / w.weight) AS rate FROM sized s, whole w),
steps AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + {mixing.TAIL} * sqrt(rate) + {mixing.TAIL}) AS BIGINT) + 1)) AS k FROM rates),
sums AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
tables AS (SELECT source, list(c ORDER BY k) AS running FROM sums GROUP BY source),
named AS (SELECT *, row_number() OVER (PARTITION BY name) AS ordinal FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null') AS name FROM documents)),
drawn AS (SELECT d.*, {_uniform(f"'{mixing.SEED}:' || {name}")} AS u, running FROM named d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT doc_id, text, lang, source, n_chars, name, ordinal, unnest(range(1, len(list_filter(running, lambda c: c <= u)) + 1)) AS copy FROM drawn)
SELECT doc_id, text, lang, source, n_chars, copy, round({_uniform(f"'{mixing.SEED + 1}:' || {name} || ':' || copy")}, 9) AS shuffle_key FROM copies"""


def url_list() -> str:
    number = lambda salt: _hex(f"'{salt}:' || host", 6)
    on, off, again = f"{number('on')} % 200", f"({number('off')} % 60 + 1)", f"({number('again')} % 90 + 1)"
    day = lambda n: f"DATE '2024-01-01' + CAST({n} AS INTEGER)"
    host = f"regexp_replace(lower(regexp_extract(coalesce(url, ''), '{url_lists.HOST}', 1)), '\\.+$', '')"
    return f"""WITH named AS (SELECT DISTINCT {host} AS h FROM pages),
hosts AS (SELECT h AS host FROM named WHERE h <> '' UNION SELECT regexp_replace(h, '^[^.]+\\.', '') FROM named WHERE h <> ''),
chosen AS (SELECT host FROM hosts WHERE len(string_split(host, '.')) > 2 AND {number('in')} % 5 = 0),
entries AS (SELECT host, {day(on)} AS dated, true AS listed FROM chosen UNION ALL SELECT host, {day(f"{on} + {off}")}, false FROM chosen
 UNION ALL SELECT host, {day(f"{on} + {off} + {again}")}, {number('back')} % 2 = 0 FROM chosen),
states AS (SELECT host, dated, bool_or(listed) AS listed FROM entries GROUP BY host, dated),
intervals AS (SELECT * FROM (SELECT host, listed, dated AS listed_from, lead(dated) OVER (PARTITION BY host ORDER BY dated) AS listed_to FROM states) WHERE listed),
captures AS (SELECT page_id, url, {day("page_id % 360")} AS fetched, count(*) AS n_captures FROM pages GROUP BY ALL),
labelled AS (SELECT *, string_split({host}, '.') AS labels FROM captures),
keyed AS (SELECT *, unnest(list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.'))) AS host FROM labelled),
hits AS (SELECT k.page_id, k.url, k.fetched, k.n_captures, i.host AS active FROM keyed k LEFT JOIN intervals i ON i.host = k.host AND k.fetched >= i.listed_from AND (i.listed_to IS NULL OR k.fetched < i.listed_to))
SELECT page_id, url, fetched, n_captures, count(active) AS n_active, arg_max(active, length(active)) AS pattern, count(active) > 0 AS blocked FROM hits GROUP BY page_id, url, fetched, n_captures"""


def license_scan() -> str:
    def template(name: str) -> str:
        every = licenses.bigrams(licenses.TEMPLATES[name])
        return f"('{name}', {sorted(set(every))!r}, {len(every)})"

    return f"""WITH RECURSIVE templates(template, known, span) AS (VALUES {", ".join(map(template, sorted(licenses.TEMPLATES)))}),
texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
paired AS (SELECT r, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS pairs FROM texts WHERE len(w) > 1),
placed AS (SELECT r, unnest(pairs) AS pair, unnest(range(len(pairs))) AS start FROM paired),
hits AS (SELECT r, template, start FROM placed JOIN (SELECT template, unnest(known) AS pair FROM templates) USING (pair)),
windows AS (SELECT r, doc_id, template, start, least(start + span, len(pairs)) + 1 AS stop, known, list_distinct(pairs[start + 1 : start + span]) AS held FROM hits JOIN paired USING (r) JOIN templates USING (template)),
scored AS (SELECT r, doc_id, template, start, stop, len(held) AS n, len(list_intersect(held, known)) AS shared, len(known) AS m FROM windows),
good AS (SELECT r, doc_id, template, start, stop, shared, round(2 * shared / (n + m), 6) AS dice FROM scored WHERE 2 * shared >= {licenses.THRESHOLD} * (n + m)),
listed AS (SELECT r, doc_id, list(struct_pack(template, start, stop, shared, dice) ORDER BY shared DESC, dice DESC, template, start) AS rest FROM good GROUP BY r, doc_id),
taken AS (SELECT r, doc_id, rest[1] AS w, rest FROM listed UNION ALL
 SELECT r, doc_id, rest[1] AS w, rest FROM (SELECT r, doc_id, list_filter(rest, lambda x: x.stop <= w.start OR w.stop <= x.start) AS rest FROM taken) WHERE len(rest) > 0)
SELECT doc_id, split_part(w.template, '/', 1) AS license, w.template AS template, CAST(w.start AS BIGINT) AS start, CAST(w.stop - w.start AS BIGINT) AS n_words, CAST(w.shared AS BIGINT) AS n_shared, w.dice AS dice FROM taken"""


def sql() -> dict[str, str]:
    return {"op6_source_mixing": source_mixing(), "op8_url_lists": url_list(), "op9_license_scan": license_scan()}
