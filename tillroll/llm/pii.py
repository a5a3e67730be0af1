"""Personal data by exact patterns and a skip-chain conditional random field."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import text_of, written

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is no personal data, the others follow KINDS.
N_LABELS = len(KINDS) + 1
#: Bound of the training sample, in rows.
TRAIN_ROWS = 4000
#: Characters of a text that are read at once to learn from, and around a span of a longer one.
WHOLE, ASIDE = 100_000, 1000
ROUNDS = 12
#: Neighbouring tokens further apart than this many characters are not tied.
REACH = 60
EPOCHS, RATE, DECAY = 300, 0.1, 1e-3

#: An entity can only start where one of these stands.
CUE = re.compile("[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

#: Mentions the patterns miss: numbers in other writing, addresses spelled out, a bare local part.
NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ ().-]{0,3}+[0-9])++(?![0-9A-Za-z])")
IPISH = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)| dot |[.,:_-])[0-9]{1,3}+){3}(?![0-9A-Za-z])")
AT_MARK = re.compile(r" ?(?:\[at\]|\(at\)| at |@) ?")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++)(?: ?(?:\[at\]|\(at\)) ?| at )[A-Za-z0-9-]++(?:(?:\.|\[\.\]| dot |\(dot\))[A-Za-z0-9-]++)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*[0-9._%+-][A-Za-z0-9._%+-]*")
PUNCTUATION = "._%+-"


class Span(NamedTuple):
    start: int
    end: int
    kind: int


def luhn(digits: str) -> bool:
    double = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in double)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The exact matches of all kinds, leftmost and not overlapping within a kind, by start, then kind."""
    if not CUE.search(text):
        return []
    found = []
    if "@" in text:
        done = 0
        at = text.find("@")
        while at >= 0:
            first = at
            while first > done and (text[first - 1] in PUNCTUATION or text[first - 1].isascii() and text[first - 1].isalnum()):
                first -= 1
            domain = DOMAIN.match(text, at + 1) if first < at else None
            # a local part is never empty, and an address ends where its domain does
            if domain:
                found.append(Span(first, domain.end(), 1))
                done = domain.end()
                at = text.find("@", done)
            else:
                done = at + 1
                at = text.find("@", at + 1)
    for match in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.group().split(".")):
            found.append(Span(match.start(), match.end(), 2))
    for match in CARD.finditer(text):
        if 12 <= match.end() - match.start() <= 37:
            digits = "".join(DIGIT.findall(match.group()))
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(Span(match.start(), match.end(), 3))
    for match in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(DIGIT.findall(match.group())) <= 15:
            found.append(Span(match.start(), match.end(), 4))
    return sorted(found, key=lambda s: (s.start, s.kind, s.end))


class Token(NamedTuple):
    start: int
    end: int
    label: int  # of a base span, else 0
    form: int  # 0 base, 1 number, 2 ip in other writing, 3 spelled address, 4 local part
    keys: tuple[str, ...]
    surface: str


def tokens_of(text: str, base: list[Span]) -> list[Token]:
    """Base spans and the other mentions that may be personal data, in order of their place.

    All other words can only have label 0 and send no evidence, so they are left out of
    the graph. Tokens that are equal or alike share a key: the last seven digits of a
    number, the four parts of an address, the local part of a mail address.
    """
    out = [Token(s.start, s.end, s.kind, 0, _keys(text[s.start:s.end], s.kind), text[s.start:s.end]) for s in base]
    taken = np.zeros(len(text) + 1, bool) if base else None
    for s in base:
        taken[s.start:s.end] = True

    def free(a: int, b: int) -> bool:
        return taken is None or not taken[a:b].any()

    def add(a: int, b: int, form: int, keys: tuple[str, ...]) -> None:
        nonlocal taken
        if keys and free(a, b):
            out.append(Token(a, b, 0, form, keys, text[a:b]))
            if taken is None:
                taken = np.zeros(len(text) + 1, bool)
            taken[a:b] = True

    for m in IPISH.finditer(text):
        add(m.start(), m.end(), 2, _keys(m.group(), 2))
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= 7:
            add(m.start(), m.end(), 1, _keys(m.group(), 4))
    locals_ = {k for t in out for k in t.keys if k[0] == "m"}
    if locals_:
        for m in SPELLED.finditer(text):
            add(m.start(), m.end(), 3, (f"m{m.group(1).lower()}",))
        for m in LOCAL.finditer(text):
            word = m.group().strip("._%+-")
            if len(word) >= 4 and f"m{word.lower()}" in locals_ and not word.isalpha():
                first = m.start() + m.group().index(word)
                add(first, first + len(word), 4, (f"m{word.lower()}",))
    return sorted(out, key=lambda t: (t.start, t.label, t.end))


def _keys(surface: str, kind: int) -> tuple[str, ...]:
    if kind == 1:
        return (f"m{surface.rpartition('@')[0].lower()}",)
    parts = re.findall("[0-9]+", surface)
    if kind == 2:
        return ("i" + ".".join(p.lstrip("0") or "0" for p in parts),)
    digits = "".join(parts)
    return (f"n{digits[-7:]}",) if len(digits) >= 7 else ()


N_FEATURES = 11


def features(token: Token) -> np.ndarray:
    digits = sum(c.isdigit() for c in token.surface)
    out = np.zeros(N_FEATURES)
    out[0] = 1
    out[token.form] = 1
    out[5:9] = digits < 9, 9 <= digits < 12, 12 <= digits <= 19, digits > 19
    out[9] = 12 <= digits <= 19 and luhn("".join(DIGIT.findall(token.surface)))
    out[10] = any(c in " ().-" for c in token.surface)
    return out


class SkipChain:
    """Weights: features to labels, neighbouring labels, and agreement of alike tokens."""

    def __init__(self):
        self.own, self.next, self.same = np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), 0.0

    def extra(self, text: str, base: list[Span]) -> list[Span]:
        """Spans beside the base ones whose most probable label is a kind."""
        tokens = tokens_of(text, base)
        if all(t.label for t in tokens):
            return []
        labels = self.marginals(tokens).argmax(axis=1)
        return [Span(t.start, t.end, int(k)) for t, k in zip(tokens, labels) if not t.label and k]

    def marginals(self, tokens: list[Token]) -> np.ndarray:
        """Loopy message passing. Alike tokens meet in one shared variable per key instead of in
        all their pairs, so a round is linear in the tokens, however often one is repeated."""
        n = len(tokens)
        unary = np.full((n, N_LABELS), -30.0)
        for i, t in enumerate(tokens):
            if t.label:
                unary[i, t.label] = 0
            else:
                unary[i] = features(t) @ self.own
        # a key that one token alone has ties nothing
        met = Counter(k for t in tokens for k in t.keys)
        keys = {k: j for j, k in enumerate(sorted(k for k, times in met.items() if times > 1))}
        of = np.array([i for i, t in enumerate(tokens) for k in t.keys if k in keys], np.int64)
        hub = np.array([keys[k] for t in tokens for k in t.keys if k in keys], np.int64)
        # without evidence a shared variable is no personal data
        prior = np.zeros((len(keys), N_LABELS))
        prior[:, 0] = self.same
        agree = np.eye(N_LABELS) * self.same
        agree[0, 0] = 0
        near = np.array([a.end + REACH >= b.start for a, b in zip(tokens, tokens[1:])], bool)[:, None]
        to_hub, to_token = np.zeros((len(of), N_LABELS)), np.zeros((len(of), N_LABELS))
        right, left = np.zeros((n, N_LABELS)), np.zeros((n, N_LABELS))
        for _ in range(ROUNDS):
            belief = unary + right + left
            np.add.at(belief, of, to_token)
            to_hub = 0.5 * to_hub + 0.5 * _passed(belief[of] - to_token, agree)
            gathered = prior.copy()
            np.add.at(gathered, hub, to_hub)
            to_token = 0.5 * to_token + 0.5 * _passed(gathered[hub] - to_hub, agree)
            if n > 1:
                fresh = np.where(near, _passed((belief - left)[:-1], self.next), 0)
                back = np.where(near, _passed((belief - right)[1:], self.next.T), 0)
                right[1:], left[:-1] = 0.5 * right[1:] + 0.5 * fresh, 0.5 * left[:-1] + 0.5 * back
        belief = unary + right + left
        np.add.at(belief, of, to_token)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)


def _passed(belief: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Log-sum-product message through a pair potential, scaled to a maximum of zero."""
    top = belief.max(axis=1, keepdims=True)
    message = np.log(np.maximum(np.exp(belief - top) @ np.exp(pair), 1e-300))
    return message - message.max(axis=1, keepdims=True)


def fit(texts: list[str]) -> SkipChain:
    """Pseudo-likelihood on base spans, their other writings, and all other mentions.

    Each base span of the sample gives two examples that the patterns miss: the mention
    in another writing beside the span itself, whose label is the span's, and the same
    mention alone, whose label is 0. Other mentions count with label 0, so what the
    model adds needs support from an alike token. Without base spans it adds nothing.
    """
    model = SkipChain()
    rows, alike, before, wanted = [], [], [], []
    for text in texts:
        base = base_spans(text)
        tokens = tokens_of(text, base)
        for i, token in enumerate(tokens):
            last = tokens[i - 1].label if i and tokens[i - 1].end + REACH >= token.start else -1
            if token.label:
                for other in _rewritten(token):
                    for support in (token.label, 0):
                        rows.append(features(other))
                        alike.append(support)
                        before.append(-1)
                        wanted.append(support)
            else:
                support = {t.label for t in tokens if t is not token and t.label and set(t.keys) & set(token.keys)}
                if not support:
                    rows.append(features(token))
                    alike.append(0)
                    before.append(last)
                    wanted.append(0)
    if not any(wanted):
        model.own[0, 0] = 30.0
        return model
    x, alike, before, wanted = np.array(rows), np.array(alike), np.array(before), np.array(wanted)
    rows_at = np.arange(len(x))
    moved, spread = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    for epoch in range(1, EPOCHS + 1):
        score = x @ model.own
        score[rows_at[alike > 0], alike[alike > 0]] += model.same
        score[before >= 0] += model.next[before[before >= 0]]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gap = -p
        gap[rows_at, wanted] += 1
        slope_next = np.zeros_like(model.next)
        np.add.at(slope_next, before[before >= 0], gap[before >= 0])
        slopes = [x.T @ gap / len(x) - DECAY * model.own, slope_next / len(x) - DECAY * model.next,
                  gap[rows_at, alike][alike > 0].sum() / len(x) - DECAY * model.same / 10]
        steps = []
        for j, g in enumerate(slopes):
            moved[j] = 0.9 * moved[j] + 0.1 * g
            spread[j] = 0.999 * spread[j] + 0.001 * g * g
            steps.append(RATE * (moved[j] / (1 - 0.9**epoch)) / (np.sqrt(spread[j] / (1 - 0.999**epoch)) + 1e-8))
        model.own, model.next, model.same = model.own + steps[0], model.next + steps[1], float(model.same + steps[2])
    return model


def _rewritten(token: Token) -> list[Token]:
    """A base span as people write it when they repeat it."""
    surface = token.surface
    digits = "".join(DIGIT.findall(surface))
    if token.label == 1:
        name, _, domain = surface.rpartition("@")
        forms = [(3, f"{name} at {domain.replace('.', ' dot ')}"), (4, name)]
    elif token.label == 2:
        forms = [(2, surface.replace(".", "[.]")), (2, surface.replace(".", "-"))]
    elif token.label == 3:
        forms = [(1, ".".join(digits[i:i + 4] for i in range(0, len(digits), 4))), (1, digits[-8:])]
    else:
        forms = [(1, digits[-7:-4] + "-" + digits[-4:]), (1, digits), (1, f"({digits[-10:-7]}) {digits[-7:-4]} {digits[-4:]}")]
    return [Token(0, len(s), 0, form, token.keys, s) for form, s in forms]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = TRAIN_ROWS) -> SkipChain:
    """Fit on a bounded sample, whatever the size of docs: in the order of a hash, half of
    max_rows ids whose text holds a base span, however rare these are, and as many others.

    Of a text longer than WHOLE characters the surroundings of its first spans are read.
    """
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("holds", T.BooleanType())])
    ids = written(texts.filter("id is not null").mapInArrow(_holding, schema).groupBy("id").agg(F.max("holds").alias("holds")))
    half = [ids.filter(f"holds = {flag}").orderBy(F.xxhash64("id"), "id").limit(-(-max_rows // 2)).select("id") for flag in ("true", "false")]
    rows = texts.join(F.broadcast(half[0].union(half[1])), "id").select("text")
    return fit(sorted(r.text for r in rows.mapInArrow(_shortened, rows.schema).limit(2 * max_rows).collect()))


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        holds = [bool(CUE.search(text) and base_spans(text)) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(holds, pa.bool_())], names=["id", "holds"])


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([around_spans(t) for t in batch.column(0).to_pylist()], pa.string())], names=["text"])


def around_spans(text: str, whole: int = WHOLE, aside: int = ASIDE) -> str:
    """A long text's words within aside characters of its base spans, up to whole characters; its start if it has none."""
    if len(text) <= whole:
        return text
    pieces, done, size = [], 0, 0
    for span in base_spans(text):
        start, end = max(done, span.start - aside), min(len(text), span.end + aside)
        # not within a word: the rest of one could be a span of its own
        while done < start and not text[start - 1].isspace() and span.start - start < 2 * aside:
            start -= 1
        while end < len(text) and not text[end].isspace() and end - span.end < 2 * aside:
            end += 1
        if end <= done:
            continue
        if size + end - start > whole:
            break
        pieces.append(text[start:end])
        done, size = end, size + end - start
    return "\n".join(pieces) if pieces else text[:whole]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind - 1]}:{s.start}:{s.end}" for s in spans)


def find(docs: DataFrame, model: SkipChain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; nothing is shuffled.

    Counts and digest are of the base spans; spans holds them and those the field adds,
    each as kind:start:end in code points. Null text is empty and has none. Rows are read
    one by one, so repeated rows and null ids stay as given.
    """
    counts = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *counts,
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(partial(_found_rows, model=model, names=schema.names), schema)


def all_spans(text: str, model: SkipChain) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans by start and kind."""
    if not CUE.search(text):
        return [], []
    base = base_spans(text)
    return base, sorted(base + model.extra(text, base), key=lambda s: (s.start, s.kind, s.end)) if base else base


def _found_rows(batches: Iterator[pa.RecordBatch], model: SkipChain, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [all_spans(text, model) for text in batch.column(1).to_pylist()]
        counts = [pa.array([sum(s.kind == k for s in base) for base, _ in rows], pa.int64()) for k in range(1, N_LABELS)]
        digests = pa.array([sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([joined(every) for _, every in rows], pa.string())], names=names)


def mask(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: every span in a text becomes its kind in brackets; n_chars follows where the table has it.

    Null text stays null. Overlapping spans are masked together, under the first one's kind.
    """
    model = train(docs)
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return docs.mapInArrow(partial(_masked_rows, model=model, at=at, size=size), docs.schema)


def masked(text: str, spans: list[Span]) -> str:
    out, done = [], 0
    for s in spans:
        if s.start >= done:
            out += [text[done:s.start], f"[{KINDS[s.kind - 1].upper()}]"]
        done = max(done, s.end)
    return "".join(out) + text[done:]


def _masked_rows(batches: Iterator[pa.RecordBatch], model: SkipChain, at: int, size: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns, texts = list(batch.columns), batch.column(at).to_pylist()
        spans = [all_spans(t or "", model)[1] for t in texts]
        if any(spans):
            fresh = [masked(t, s) if s else t for t, s in zip(texts, spans)]
            columns[at] = pa.array(fresh, batch.schema.field(at).type)
            if size is not None:
                kept = columns[size].to_pylist()
                columns[size] = pa.array([len(t) if s else n for t, s, n in zip(fresh, spans, kept)], batch.schema.field(size).type)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
