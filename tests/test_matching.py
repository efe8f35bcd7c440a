"""Keyword matching against a plain version over whole documents, and worked cases."""

import collections
import json
import unicodedata

import pytest

from murmur.functions import text
from murmur.operators import matching
from murmur.plans import matching as plans
from murmur.sources.views import Views

FOLDER = "/root/testdata/sf0.01"


def plain_form(value, fold=None):
    """The normal form, character by character."""
    if fold is None:
        scripts = collections.Counter()
        for ch in value:
            if ch.isalpha():
                name = unicodedata.name(ch, "")
                scripts["HAN" if name.startswith(("CJK", "IDEOGRAPHIC")) else name.split(" ")[0]] += 1
        fold = not scripts or max(scripts, key=scripts.get) not in text.MARK_SCRIPTS
    out, at = [], []
    for i, ch in enumerate(value):
        if text.is_invisible(ch):
            continue
        for c in unicodedata.normalize("NFKC", ch).casefold():
            kind = unicodedata.category(c)
            if kind[0] == "M":
                parts = [] if fold else [c]
            elif c.isspace() or kind in text.SEPARATORS:
                parts = [] if not out or out[-1] == " " else [" "]
            else:
                parts = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)] if fold else [c]
            out += parts
            at += [i] * len(parts)
    while out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), at


ODD = ["Visit the Café, today!", "Straße  und\tWEG", "a​--b  ", "", " . ", "ﬁne ½ Ⅳ", "नमस्ते दुनिया", "他去北京人民", "สวัสดีประเทศไทย", "éà İx", "\ud800x"]


@pytest.mark.parametrize("value", ODD)
def test_normal_form(value):
    for fold in (None, True, False):
        got, at = text.normalize(value, fold)
        assert (got, at) == plain_form(value, fold)


def plain_matches(docs, keywords, stations):
    """Every form of every keyword looked for in every document of its stations."""
    bound = collections.defaultdict(set)
    for s in stations:
        bound[s.campaign_id].add(s.station_id)
    terms = {}
    owners = collections.defaultdict(list)
    for k in keywords:
        forms, seen = [(k.canonical_value, None, "canonical")], {k.canonical_value.casefold()}
        for a in json.loads(k.aliases)[:200]:
            a = {"value": a} if isinstance(a, str) else a
            value, kind = (a.get("value") or "").strip(), (a.get("kind") or "canonical").strip().lower()
            if value and value.casefold() not in seen:
                seen.add(value.casefold())
                forms.append((value, (a.get("language") or "").strip().lower() or None, kind if kind in matching.LEVELS else "canonical"))
        needs = k.match_mode == "tokens" and text.has_boundaries(k.canonical_value)
        for s in bound[k.campaign_id]:
            owners[s, k.keyword_id].append((k.canonical_value.casefold(), k.campaign_id, k.canonical_value, k.keyword_type))
            for value, language, kind in forms:
                for fold in (None, True, False):
                    if key := plain_form(value, fold)[0]:
                        ids, whole = terms.get((s, key, language, kind), (set(), True))
                        terms[s, key, language, kind] = (ids | {k.keyword_id}, whole and needs)
    by_station = collections.defaultdict(list)
    for (s, *t), x in terms.items():
        by_station[s].append((*t, *x))
    out = collections.Counter()
    for d in docs:
        plain, at = plain_form(d.text or "")
        found = collections.defaultdict(set)
        for key, language, kind, ids, whole in by_station[d.station_id]:
            i = plain.find(key)
            while i >= 0:
                j = i + len(key)
                inside = (i and plain[i - 1].isalnum() and plain[i].isalnum()) or (j < len(plain) and plain[j - 1].isalnum() and plain[j].isalnum())
                if not (whole and inside):
                    level = matching.LEVELS[kind]
                    for k in ids:
                        first = min(owners[d.station_id, k])
                        if not (kind == "translation" and first[3] in matching.STRICT_KINDS):
                            found[k].add((at[i] - at[j - 1] - 1, -matching.CONFIDENCE[level], at[i], at[j - 1] + 1, level, kind, language or ""))
                i = plain.find(key, i + 1)
        for k, hits in found.items():
            kept = []
            for h in sorted(hits):
                if all(h[3] <= x[2] or x[3] <= h[2] for x in kept):
                    kept.append(h)
            for h in kept:
                out[d.doc_id, k, h[2], h[3], d.text[h[2] : h[3]], h[4], tuple(sorted({o[1] for o in owners[d.station_id, k]}))] += 1
    return out


def test_against_a_plain_matcher(spark):
    v = Views(spark, FOLDER)
    want = plain_matches(plans.transcripts(v).collect(), plans.keywords(v).collect(), plans.stations(v).collect())
    got = plans.keyword_matches(v)
    rows = collections.Counter((r.doc_id, r.keyword_id, r.start, r.end, r.matched, r.match_level, tuple(r.campaign_ids)) for r in got.collect())
    assert rows == want
    assert len(want) > 50_000
    few = matching.matches(plans.transcripts(v), *plans._index(v), bound=50).count()  # several passes of few forms
    assert few == sum(want.values())


def test_reports_of_matches(spark):
    """What is made of matches, against plain counts over them."""
    v = Views(spark, "/root/testdata/sf0.001")
    docs, found = plans.transcripts(v).collect(), plans.keyword_matches(v).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    want = {d.doc_id: (len(plain_form(d.text or "")[0]), len(m := by[d.doc_id]), sum(r.match_level not in matching.UNCONFIRMED for r in m), sorted({r.keyword_id for r in m}) or None, sorted({c for r in m for c in r.campaign_ids}) or None) for d in docs}
    got = {r.doc_id: (r.scanned_characters, r.n_matches, r.n_confirmed, r.keyword_ids, r.campaign_ids) for r in plans.match_report(v).collect()}
    assert got == want
    assert all(r.n_candidates == r.n_matches - r.n_confirmed for r in plans.match_report(v).limit(50).collect())
    best = {}
    for r in sorted(found, key=lambda r: (-r.confidence, r.start)):
        best.setdefault((r.doc_id, r.keyword_id), (r.start, r.matched, r.confidence))
    assert {(r.doc_id, r.keyword_id): (r.start, r.matched, r.confidence) for r in plans.best_matches(v).collect()} == best
    text_of, times = {d.doc_id: d.text or "" for d in docs}, set()
    for r in found:
        at, over = 0, []
        for line in text_of[r.doc_id].split("\n"):
            if r.start < at + len(line) and at < r.end:
                over.append((at * 80, (at + len(line)) * 80))
            at += len(line) + 1
        times.add((r.doc_id, r.keyword_id, r.start, r.end, min((a for a, _ in over), default=None), max((b for _, b in over), default=None)))
    assert {tuple(r) for r in plans.timed_matches(v).collect()} == times and len(times) == len(found)


def test_hints_and_prompts_of_stations(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    words, bound = plans.keywords(v).collect(), collections.defaultdict(set)
    for s in plans.stations(v).collect():
        bound[s.campaign_id].add(s.station_id)
    forms = []  # in index order: canonical value, keyword, campaign, place
    for k in words:
        seen = {k.canonical_value.casefold()}
        own = [(k.canonical_value, None)]
        for a in json.loads(k.aliases):
            a = {"value": a} if isinstance(a, str) else a
            value = (a.get("value") or "").strip()
            if value and value.casefold() not in seen:
                seen.add(value.casefold())
                own.append((value, (a.get("language") or "").strip().lower() or None))
        forms += [((k.canonical_value.casefold(), k.keyword_id, k.campaign_id, i), k.campaign_id, value, language) for i, (value, language) in enumerate(own)]
    spoken = collections.defaultdict(dict)
    for d in v.table("documents").orderBy("doc_id").collect():
        if d.lang:
            spoken[d.source].setdefault(d.lang.strip().lower(), None)
    hints, prompts = {}, {}
    for s in {x for b in bound.values() for x in b}:
        mine = sorted(f for f in forms if s in bound[f[1]])
        hints[s] = list(dict.fromkeys([*spoken[s], *(f[3] for f in mine if f[3])]))[:8]
        parts, seen = [], set()
        for _, _, value, _ in mine:
            marker = plain_form(value.strip())[0]
            if marker and marker not in seen and len(value.strip()) <= 60:
                seen.add(marker)
                if len(", ".join([*parts, value.strip()])) > 400:
                    break
                parts.append(value.strip())
        prompts[s] = ", ".join(parts)
    got = collections.defaultdict(dict)
    for r in plans.station_hints(v).collect():
        got[r.station_id][r.hint] = r.language
    assert {s: [h[i] for i in sorted(h)] for s, h in got.items() if s in hints} == hints
    assert {r.station_id: r.prompt for r in plans.station_prompts(v).collect()} == prompts


def test_payloads_round_trip(spark, tmp_path):
    """Automata built once, stored and loaded give the same hits; a payload that was changed is refused."""
    v = Views(spark, "/root/testdata/sf0.001")
    terms, owners = plans._index(v)
    forms = matching.forms_of(terms)
    matching.payloads(forms, bound=300).write.parquet(f"{tmp_path}/index")
    built = spark.read.parquet(f"{tmp_path}/index")
    assert built.count() > 1 and built.agg({"n_forms": "sum"}).head()[0] == forms.count()
    key = lambda df: sorted((r.doc_id, r.keyword_id, r.start, r.end, r.match_level) for r in df.collect())
    assert key(matching.matches(plans.transcripts(v), terms, owners, built=built)) == key(plans.keyword_matches(v))
    again = {r.shard: r.fingerprint for r in matching.payloads(forms, bound=300).collect()}
    assert {r.shard: r.fingerprint for r in built.collect()} == again
    from pyspark.sql import functions as F

    swapped = built.withColumn("fingerprint", F.reverse("fingerprint"))
    with pytest.raises(Exception, match="fingerprint is"):
        matching.scanned(plans.transcripts(v), swapped).count()
    none = spark.createDataFrame([], terms.schema)
    assert matching.matches(plans.transcripts(v), none, owners).count() == 0


def small(spark, keywords, docs, fuzzy=False):
    rows = [(c, k, value, kind, mode, json.dumps(aliases)) for c, k, value, kind, mode, aliases in keywords]
    words = spark.createDataFrame(rows, "campaign_id long, keyword_id long, canonical_value string, keyword_type string, match_mode string, aliases string")
    stations = spark.createDataFrame([(c, "s") for c in {r[0] for r in rows}], "campaign_id long, station_id string")
    texts = spark.createDataFrame([(i, "s", t) for i, t in enumerate(docs)], "doc_id long, station_id string, text string")
    found = matching.matches(texts, matching.index_terms(matching.surface_forms(words), stations), matching.entries(words, stations), fuzzy)
    return texts, found, sorted(((r.doc_id, r.keyword_id, r.start, r.end, r.matched, r.match_level, r.campaign_ids) for r in found.collect()), key=repr)


def test_worked_cases(spark):
    keywords = [(1, 7, "nvidia", "brand", "tokens", ["NVIDIA RTX"]), (2, 7, "NVIDIA", "brand", "tokens", []), (1, 8, "cafe", "topic", "tokens", []), (1, 9, "北京", "place", "tokens", []), (1, 10, "ประเทศ", "place", "tokens", []), (1, 11, "cat", "topic", "substring", []), (1, 12, "Apple", "brand", "tokens", [{"value": "pomme", "kind": "translation"}]), (1, 13, "apple", "topic", "tokens", [{"value": "pomme", "kind": "translation"}]), (1, 14, " ", "topic", "tokens", [])]
    docs = ["Introducing the NVIDIA RTX!", "Visit the Café, today, cafes", None, "", "他去北京人民", "สวัสดีประเทศไทย", "concatenate", "une pomme"]
    texts, found, got = small(spark, keywords, docs)
    assert got == sorted([(0, 7, 16, 26, "NVIDIA RTX", "exact", [1, 2]), (1, 8, 10, 14, "Café", "exact", [1]), (4, 9, 2, 4, "北京", "exact", [1]), (5, 10, 6, 12, "ประเทศ", "exact", [1]), (6, 11, 3, 6, "cat", "exact", [1]), (7, 13, 4, 9, "pomme", "alias", [1])], key=repr)
    report = {r.doc_id: (r.scanned_characters, r.n_matches, r.n_confirmed) for r in matching.report(texts, found).collect()}
    assert report == {0: (26, 1, 1), 1: (26, 1, 1), 2: (0, 0, 0), 3: (0, 0, 0), 4: (6, 1, 1), 5: (15, 1, 1), 6: (11, 1, 1), 7: (9, 1, 1)}


def test_one_edit_away(spark):
    keywords = [(1, 1, "weather", "topic", "tokens", []), (1, 2, "storm", "topic", "tokens", [])]
    _, _, got = small(spark, keywords, ["the wether and the weather, strom, weathers, whether"], fuzzy=True)
    assert {(r[4], r[5]) for r in got} == {("weather", "exact"), ("wether", "fuzzy"), ("weathers", "fuzzy")} and len(got) == 3


def test_spans_and_keys():
    assert text.original_span("Der Weg zur Straßenbahn", "STRASSE") == (12, 23)
    assert text.exact_span("concat cat", "CAT") == (7, 10)
    assert text.exact_span("visit the Café.", "cafe") == (10, 14)
    assert text.highlight_span("Straße STRASSE", "strasse") == (7, 14)
    assert text.sentence_around("One. Two is 3.5 long! Three", 5, 8) == "Two is 3.5 long!"
    assert text.variant_keys("Café") == ["cafe", "café"]
    assert text.token_set("The the cat") == {"the", "cat"} and text.token_set("北京") == set()
    assert text.slug("Ünited Stätes!") == "united-states" and text.slug("北京") == "keyword"
