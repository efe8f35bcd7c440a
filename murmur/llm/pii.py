"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The field's sites are a document's words with a digit or an at sign. Each has one of five labels (none or a kind). Sites
share potentials with the site before them (chain) and with the last earlier similar site (skip), however distant.
Similar are sites of one normal form, of the same last seven digits (of a site, or of a stretch of neighbours such as
"(415) 555 0134"), of the same groups of digits whatever stands between them, or of the same name before an at sign.
Loopy sum-product messages settle the labels, the base spans' own being given, so repeats of a token agree with it. A
site labelled with probability ``SURE`` or more adds a span where no base span lies; neighbours of one kind join.

Training is by pseudo-likelihood on a bounded sample: at most ``SAMPLE`` documents of up to ``SAMPLE_CHARS`` characters
with a digit or an at sign, drawn by hash of doc_id and text. The base patterns label every clear form and leave every
other one, so their labels alone can't teach what a repeat is worth. So each text with base spans is used once more with
``REPEATS`` of them repeated at other places in another form (other separators, no plus sign, no end of the domain), the
label carried over, and as many strangers of the same forms, with other digits and names, labelled none. What tells the
ones from the others is the skip edge to a labelled site. The sample fits the weights only; spans and counts come from
every whole text.

Edge cases: a null or empty text has no spans; equal rows get equal results; null doc_ids stay null; an empty table, or
one without a site, trains no field and adds nothing; further columns are ignored. Patterns are matched in linear time
whatever the text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, sliced

KINDS = ("email", "ip", "card", "phone")
SAMPLE, SAMPLE_CHARS = 2000, 20_000
SURE = 0.9
#: Neighbouring sites join up to so many digits.
MOST_DIGITS = {"card": 19, "phone": 15}
ROUNDS, DAMPING = 12, 0.3
#: Base spans of a text that training repeats in other forms, and edges that one step of the message passing holds.
REPEATS, SLICE = 3, 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_SITE = re.compile(r"[0-9@]")
_GROUP = re.compile(r"[0-9]+")
_QUAD = re.compile(r"[0-9]{1,4}(?:\.[0-9]{1,4}){3}")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str):
    """Each at sign with the longest local part before it that no earlier match holds."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str):
    """Chains of numbers joined by dots, four by four."""
    for m in _NUMBERS.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", a, b) for a, b in addresses(text)]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < 38 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


class Sites:
    """The sites of some texts as one graph: features, labels' spans, and edges that stay inside each text."""

    def __init__(self, texts: list[str]):
        self.doc, self.start, self.end = array("q"), array("q"), array("q")
        chain, skip, rows = array("q"), array("q"), bytearray()
        for d, text in enumerate(texts):
            if not _SITE.search(text):
                continue
            last, seen, run, held = None, {}, [], ""
            for m in _TOKEN.finditer(text):
                token = m.group()
                if not _SITE.search(token):
                    continue
                i = len(self.doc)
                core = token.strip(".,;:!?\"'()[]<>{}|*#&$%")
                lead = token.find(core)
                before = last is not None and m.start() - self.end[last] <= 2
                if not before:
                    skip += self._similar(run, held, seen)
                    run, held = [], ""
                self.doc.append(d)
                self.start.append(m.start() + lead)
                self.end.append(m.start() + lead + len(core))
                rows += bytes(self.features(token, core, before))
                if before:
                    chain += array("q", (last, i))
                digits = _digits(core)
                if len(digits) < 7:
                    run.append(i)
                    held += digits
                partners = set()
                for key in self.keys(core, digits):
                    if key in seen:
                        partners.add(seen[key])
                    seen[key] = i
                for j in sorted(partners):
                    skip += array("q", (j, i))
                last = i
            skip += self._similar(run, held, seen)
        self.x = np.frombuffer(bytes(rows), dtype=np.uint8).reshape(-1, WIDTH)
        self.chain, self.skip = (np.frombuffer(e.tobytes(), dtype=np.int64).reshape(-1, 2) for e in (chain, skip))

    @staticmethod
    def keys(core: str, digits: str) -> set[tuple[str, str]]:
        """What a site shares with similar ones."""
        out = {("form", core.lower())}
        if len(digits) >= 7:
            out.add(("end", digits[-7:]))
        if len(groups := _GROUP.findall(core)) >= 3:
            out.add(("groups", "-".join(groups)))
        if "@" in core[1:]:
            out.add(("name", core.partition("@")[0].lower()))
        return out

    @staticmethod
    def _similar(run: list[int], digits: str, seen: dict) -> array:
        """Edges from a stretch of short neighbours to the last site of the same last seven digits."""
        edges = array("q")
        if len(run) > 1 and len(digits) >= 7:
            key = ("end", digits[-7:])
            if key in seen:
                for i in run:
                    edges += array("q", (seen[key], i))
            seen[key] = run[-1]
        return edges

    @staticmethod
    def features(token: str, core: str, before: bool) -> list[bool]:
        digits = _digits(core)
        n, dots = len(digits), core.count(".")
        name, _, domain = core.partition("@")
        row = [True, "@" in core, bool(name and "." in domain), bool(_QUAD.fullmatch(core)), token.startswith("+"), "(" in token or ")" in token, "-" in core, before, n == len(core), any(c.isalpha() for c in core), 13 <= n <= 19 and luhn(digits)]
        row += [dots == k for k in (0, 1, 2, 3)]
        row += [lo <= n <= hi for lo, hi in ((1, 1), (2, 2), (3, 3), (4, 4), (5, 8), (9, 12), (13, 19))]
        return row

    def labels(self, spans: list[list[tuple[str, int, int]]]) -> np.ndarray:
        """The kind (from 1) of the span that holds most of each site, else 0."""
        out = np.zeros(len(self.doc), dtype=np.int64)
        for i, (d, a, b) in enumerate(zip(self.doc, self.start, self.end, strict=True)):
            for kind, s, e in spans[d]:
                if min(b, e) - max(a, s) > (b - a) / 2:
                    out[i] = KINDS.index(kind) + 1
                    break
        return out


WIDTH, LABELS = 22, 1 + len(KINDS)


def _strange(form: str, rng: np.random.Generator) -> str:
    """Other digits, and other letters before an at sign."""
    name, sign, rest = form.rpartition("@")
    name = "".join(chr(97 + rng.integers(26)) if c.isalpha() else c for c in name)
    return "".join(str(rng.integers(10)) if c.isdigit() else c for c in name + sign + rest)


def other_form(kind: str, span: str, rng: np.random.Generator) -> str:
    """What a span looks like where its pattern misses it."""
    if kind == "email":
        name, _, domain = span.partition("@")
        return rng.choice([name.lower() + "@" + domain.split(".")[0], name.upper() + "@" + domain.split(".")[0]])
    groups = _GROUP.findall(span)
    if kind == "ip":
        return rng.choice(["-", "_", ":"]).join(groups)
    if kind == "card":
        d = "".join(groups)
        return rng.choice([".", "/", "_"]).join(d[i : i + 4] for i in range(0, len(d), 4))
    if len(groups) > 1 and rng.random() < 0.8:
        groups = groups[1:] if len("".join(groups[1:])) >= 7 else groups  # without the country
    return rng.choice(["-", ".", "/", "", " "]).join(groups)


def examples(texts: list[str], rng: np.random.Generator) -> tuple[list[str], list[list[tuple[str, int, int]]]]:
    """The texts with their base spans; and those that have some once more, with repeats in other forms that keep the label
    and strangers of the same forms that have none."""
    out, spans = [], []
    for text in texts:
        base = base_spans(text)
        out.append(text)
        spans.append(base)
        if not base:
            continue
        more = []
        for k in rng.choice(len(base), min(REPEATS, len(base)), replace=False).tolist():
            kind, a, b = base[k]
            form = other_form(kind, text[a:b], rng)
            strange = _strange(form, rng)
            more += [(form, kind), *[(strange, None)] * (1 + (rng.random() < 0.3))]
        gaps = [0, *(m.start() for m in re.finditer(r"\s", text) if not any(a <= m.start() < b for _, a, b in base)), len(text)]
        at = sorted(rng.choice(gaps, len(more)).tolist())
        order = rng.permutation(len(more)).tolist()
        parts, carried, done, size = [], [], 0, 0
        for p, k in zip(at, order, strict=True):
            form, kind = more[k]
            word = " some " + form + " more "
            parts += [text[done:p], word]
            size += p - done + len(word)
            done = p
            if kind:
                carried.append((kind, size - 6 - len(form), size - 6))
        made = "".join(parts) + text[done:]
        out.append(made)
        spans.append(carried + base_spans(made))
    return out, spans


def train(texts: list[str], steps: int = 4000, decay: float = 1e-5, seed: int = 11):
    """Weights (features x labels), chain and skip potentials (label x label): the greatest composite likelihood of
    the examples' labels less ``decay`` times half the squared weights, by accelerated ascent with restarts until the
    slope is small. It is the mean over sites of two logarithms: of the label given the neighbours' labels, and of the
    label by the site's own features, without which the potentials would leave nothing to be said by a plus sign."""
    made, spans = examples(texts, np.random.default_rng(seed))
    sites = Sites(made)
    n = len(sites.doc)
    if not n:
        return None
    hot = np.eye(LABELS)[sites.labels(spans)]
    before, after, far = (np.zeros((n, LABELS)) for _ in range(3))  # labels before, after and at skip partners
    np.add.at(before, sites.chain[:, 1], hot[sites.chain[:, 0]])
    np.add.at(after, sites.chain[:, 0], hot[sites.chain[:, 1]])
    np.add.at(far, sites.skip[:, 1], hot[sites.skip[:, 0]])
    np.add.at(far, sites.skip[:, 0], hot[sites.skip[:, 1]])
    x = sites.x.astype(np.float64)
    every = np.concatenate([x, before, after, far], axis=1)
    rate = 1 / (np.linalg.eigvalsh(every.T @ every / n)[-1] + decay)  # a softmax bends by a half at most, twice that for the two terms
    ends = np.cumsum([WIDTH, LABELS, LABELS])
    theta = ahead = np.zeros((WIDTH + 2 * LABELS, LABELS))
    pace = 1.0
    for _ in range(steps):
        w, c, s = np.split(ahead, ends[:2])
        gap = hot - _softmax(x @ w + before @ c + after @ c.T + far @ s)
        both = far.T @ gap
        slope = np.concatenate([x.T @ (gap + hot - _softmax(x @ w)), before.T @ gap + gap.T @ after, (both + both.T) / 2]) / n - decay * ahead
        if np.abs(slope).max() < 1e-6:
            break
        fresh = ahead + rate * slope
        if (slope * (fresh - theta)).sum() < 0:
            pace = 1.0
        quick = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = fresh + (pace - 1) / quick * (fresh - theta)
        theta, pace = fresh, quick
    return tuple(np.split(theta, ends[:2]))


def _softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def marginals(sites: Sites, model, known: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities by loopy sum-product over the graph of all texts at once; where ``known`` is over 0, the label is
    given.

    Both directions of all edges of a kind share one potential table, and messages are worked out ``SLICE`` edges at a
    time: memory is some 300 bytes a site, whatever the text."""
    w, c, s = model
    unary = np.concatenate([sites.x[i : i + SLICE].astype(np.float64) @ w for i in range(0, max(1, len(sites.x)), SLICE)])
    if known is not None:
        given = np.flatnonzero(known > 0)
        unary[given] = -1e3
        unary[given, known[given]] = 0
    kinds = [(sites.chain[:, 0], sites.chain[:, 1], c), (sites.chain[:, 1], sites.chain[:, 0], c.T), (sites.skip[:, 0], sites.skip[:, 1], s), (sites.skip[:, 1], sites.skip[:, 0], s.T)]
    messages = [np.zeros((len(src), LABELS), dtype=np.float32) for src, _, _ in kinds]

    def believed() -> np.ndarray:
        belief = unary.copy()
        for (_, dst, _), held in zip(kinds, messages, strict=True):
            for k in range(LABELS):
                belief[:, k] += np.bincount(dst, held[:, k], minlength=len(belief))
        return belief

    for _ in range(ROUNDS if len(sites.chain) + len(sites.skip) else 0):
        belief, fresh = believed(), []
        for i, (src, _, pair) in enumerate(kinds):
            back, new = messages[i ^ 1], np.empty_like(messages[i])
            for a in range(0, len(src), SLICE):
                held = belief[src[a : a + SLICE]] - back[a : a + SLICE]
                joint = held[:, :, None] + pair
                top = joint.max(axis=1, keepdims=True)
                out = np.log(np.exp(joint - top).sum(axis=1)) + top[:, 0]
                new[a : a + SLICE] = out - out.max(axis=1, keepdims=True)
            fresh.append(DAMPING * messages[i] + np.float32(1 - DAMPING) * new)
        messages = fresh
    return _softmax(believed())


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], model) -> dict[int, list[tuple[str, int, int]]]:
    """Spans that the field adds to each text, outside the base spans."""
    sites = Sites(texts)
    out: dict = defaultdict(list)
    if not len(sites.doc):
        return out
    p = marginals(sites, model, sites.labels(base))
    label, sure = p.argmax(axis=1), p.max(axis=1) >= SURE
    linked = set(sites.chain[:, 1].tolist())
    for i in np.flatnonzero((label > 0) & sure).tolist():
        d, a, b = sites.doc[i], sites.start[i], sites.end[i]
        kind = KINDS[label[i] - 1]
        if b <= a or any(s < b and a < e for _, s, e in base[d]):
            continue
        before = out[d][-1] if out[d] else None
        if i in linked and before and before[0] == kind and before[2] == sites.end[i - 1] and len(_digits(texts[d][before[1] : b])) <= MOST_DIGITS.get(kind, 0):
            out[d][-1] = (kind, before[1], b)
        else:
            out[d].append((kind, a, b))
    return out


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sample(df: DataFrame, bound: int = SAMPLE) -> list[str]:
    """``bound`` distinct rows at most, those of the least hashes of doc_id and text. No more than that is collected,
    however often a doc_id or a row repeats: hashes under a share of their range are reduced to distinct ones first."""
    rows = id_and_text(df).filter((F.char_length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]")).withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)))
    n = rows.agg(F.approx_count_distinct("h").alias("n")).head().n
    share = min(1.0, 2 * bound / max(1, n))
    some = rows.filter(F.col("h") < int(share * (1 << 40))).groupBy("h").agg(F.min("text").alias("text"))
    return [r.text for r in some.orderBy("h").limit(bound).collect()]


def scan(df: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (text; base and added ones) and n_spans of each row."""
    model = train(sample(df, bound))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in sliced(texts):
                part = texts[a:b]
                base = [base_spans(t) for t in part]
                more = added_spans(part, base, model) if model is not None else {}
                spans = [sorted(x + more[i], key=lambda s: (KINDS.index(s[0]), s[1])) if i in more else x for i, x in enumerate(base)]
                counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *counts, pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in base]), pa.array([written(x) for x in spans]), pa.array([len(x) for x in spans], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return id_and_text(df).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
