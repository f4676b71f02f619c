"""Personal data: plain patterns, then identifiers found by their context.

Spans that the plain patterns find are seeds.  The words before a seed are a
lexical pattern (signs may stand among them, but never alone); the same pattern before another identifier-like token links
the two.  On the graph of patterns and instances, confidence passes to and fro
for a few rounds: a pattern is as good as the share of its mentions that are
trusted, an unseen instance as good as its best pattern.  Tokens that stand
behind a pattern of high confidence are added to the spans, and count as seeds
in the next generation; that goes on until a generation adds no pattern.

Texts are read once; what goes on from there is a narrow table of mentions.
The graph is aggregated before each join, so a pattern that stands before a
third of all mentions is one row per instance.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefloom.llm.common import Stages, text_of

KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS = 3
# a pattern needs so many different seeds, and this confidence
LEAST_SEEDS = 3
CONFIDENT = 0.75
# mentions without worth that every pattern is charged with
DOUBT = 1.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits matches from its first digit or not at all
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"""[^\s"'<>=,;()\[\]{}|]+""")
_CONTEXT = re.compile(r"[^\W\d_]+|[^\w\s]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each @, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", match.end() if match else at + 1)


def _luhn(digits: list[str]) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        n = int(d) * (1 + at % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index into KINDS, end) of the plain patterns, in order."""
    if not _MARK.search(text):
        return []
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        # 19 digits have 18 separators at most
        digits = _DIGIT.findall(m[0]) if m.end() - m.start() <= 37 else []
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _identifier(token: str) -> bool:
    return len(token) >= 6 and ("@" in token or len(_DIGIT.findall(token)) >= 2)


def _surface(said: str) -> str:
    """What an instance of the graph goes by: itself, or a digest of all of it where that is shorter."""
    return said if len(said) <= 64 else hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest()


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and identifier-like tokens with the patterns before them.

    A pattern is the last two or three words or signs before the mention, in
    lower case, one of them a word.  Tokens that touch a seed are part of it.
    """
    found = [(s, e, True) for s, _, e in spans]
    taken = sorted((s, e) for s, _, e in spans)
    at = 0
    if _MARK.search(text):
        for m in _TOKEN.finditer(text):
            if not _MARK.search(m[0]):
                continue
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            token = m[0].rstrip(".:!?")
            if not (at < len(taken) and taken[at][0] < m.end()) and _identifier(token):
                found.append((m.start(), m.start() + len(token), False))
    # one pass over the words of the text, however far a mention's words stand before it
    contexts: dict[int, list[str]] = {}
    last, words = deque(maxlen=3), _CONTEXT.finditer(text)
    ahead = next(words, None) if found else None
    for start in sorted({start for start, _, _ in found}):
        while ahead is not None and ahead.start() < start:
            last.append(ahead.span())
            ahead = next(words, None)
        contexts[start] = [text[s : min(e, start)].lower() for s, e in last]
    out = []
    for start, end, seed in found:
        before = contexts[start]
        patterns = [" ".join(before[-n:]) for n in (2, 3) if len(before) >= n and any(map(str.isalpha, before[-n:]))]
        out.append({"start": start, "end": end, "surface": _surface(text[start:end].lower()), "patterns": patterns, "seed": seed})
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_MENTION = pa.struct([
    ("start", pa.int64()), ("end", pa.int64()), ("surface", pa.string()), ("patterns", pa.list_(pa.string())), ("seed", pa.bool_()),
])
_SCHEMA = (
    "row_key BIGINT, spans ARRAY<STRUCT<start: BIGINT, kind: INT, end: BIGINT>>, mentions ARRAY<STRUCT<start: BIGINT, "
    "end: BIGINT, surface: STRING, patterns: ARRAY<STRING>, seed: BOOLEAN>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, found = [], []
        for t in b.column(2):
            text = t.as_py()
            own = base_spans(text)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
            found.append(mentions(text, own))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(spans, pa.list_(_SPAN)), pa.array(found, pa.list_(_MENTION))],
            ["doc_id", "row_key", "spans", "mentions"],
        )


def row_key() -> Column:
    """Rows that agree in id and text have the same spans, so they share a key."""
    return F.xxhash64("doc_id", text_of())


def _scored(edges: DataFrame, stages: Stages, name: str, rounds: int) -> DataFrame:
    """``pattern, surface, seed, n`` -> ``pattern, confidence`` of the patterns with enough seeds."""
    worth = F.col("seed").cast("double")
    patterns = None
    for r in range(rounds):
        weighed = edges.withColumn("worth", worth)
        if patterns is not None:
            passed = edges.where("NOT seed").join(patterns.select("pattern", "confidence"), "pattern")
            passed = passed.groupBy("surface").agg(F.max("confidence").alias("passed"))
            weighed = edges.join(passed, "surface", "left").withColumn("worth", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("passed", F.lit(0.0))))
        scored = weighed.groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("worth")) / (F.sum("n") + DOUBT)).alias("confidence"),
            F.sum(F.col("seed").cast("int")).alias("seeds"),
        )
        # patterns without enough seeds pass nothing on
        patterns = stages.write(f"{name}-{r}", scored.where(F.col("seeds") >= LEAST_SEEDS))
    return patterns


def trusted_patterns(edges: DataFrame, stages: Stages, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, surface, seed, n`` -> ``pattern, confidence`` of the confident patterns.

    A generation is ``rounds`` rounds.  What stands behind its confident
    patterns is a seed from then on, so these stay confident, and a generation
    that adds none is the last.
    """
    edges = stages.write("edges-0", edges)
    # surfaces that the plain patterns find are seeds already: a pattern counts each once
    plain = edges.where("seed").select("surface").distinct()
    generation, known = 0, 0
    while True:
        patterns = _scored(edges, stages, f"patterns-{generation}", rounds)
        good = patterns.where(F.col("confidence") >= CONFIDENT).select("pattern", "confidence")
        count = good.count()
        if count <= known:
            return good
        generation, known = generation + 1, count
        fresh = edges.where("NOT seed").join(good.select("pattern"), "pattern").select("surface").distinct()
        fresh = fresh.join(plain, "surface", "left_anti").withColumn("fresh", F.lit(True))
        marked = edges.join(fresh, "surface", "left").withColumn("seed", F.col("seed") | F.coalesce("fresh", F.lit(False)))
        edges = stages.write(f"edges-{generation}", marked.drop("fresh").select("pattern", "surface", "seed", "n"))


def find_personal_data(docs: DataFrame, stages: Stages) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, row_key, base, spans``, a row per row.

    ``base`` and ``spans`` are arrays of ``start, kind, end`` (code points, end
    exclusive; ``kind`` is an index into ``KINDS``), sorted; ``spans`` holds
    ``base`` and what the patterns discovered.  A null text is an empty one and
    has none.  Repeated rows get equal results.
    """
    rows = docs.select("doc_id", row_key().alias("row_key"), text_of().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = stages.write("scanned", rows.mapInArrow(_scan, f"doc_id {kind}, {_SCHEMA}"))
    said = scanned.where(F.size("mentions") > 0).select("doc_id", "row_key", F.explode("mentions").alias("m")).select("doc_id", "row_key", "m.*")
    linked = said.select("doc_id", "row_key", "start", "end", "surface", "seed", F.explode("patterns").alias("pattern"))
    edges = linked.groupBy("pattern", "surface", "seed").agg(F.count("*").alias("n"))
    good = trusted_patterns(edges, stages)
    fresh = linked.where("NOT seed").join(good, "pattern")
    span = F.struct("start", F.lit(KINDS.index("context")).alias("kind"), "end")
    added = fresh.groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).agg(F.collect_set(span).alias("added"))
    added = stages.write("added", added)
    same = (F.col("row_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    joined = scanned.select("doc_id", "row_key", "spans").join(added, same, "left")
    both = F.sort_array(F.when(F.col("added").isNull(), F.col("spans")).otherwise(F.array_union("spans", "added")))
    return joined.select("doc_id", "row_key", F.col("spans").alias("base"), both.alias("spans"))


def span_list(spans: str) -> Column:
    """Spans as text: ``kind:start:end``, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', {names}[s.kind], s.start, s.end)), ',')")


def redact(docs: DataFrame, stages: Stages) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets.

    Where spans overlap, the first one's mark stands for both.  Other columns
    stay; ``n_chars``, where there is one, is that of the new text.  Null texts
    stay null.
    """
    found = find_personal_data(docs, stages).where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_found"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_found"])
    joined = docs.withColumn("_key", row_key())
    joined = joined.join(found, (F.col("_key") == F.col("_found")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    walked = F.expr(
        "aggregate(_spans, named_struct('at', 0L, 'out', ''), (a, s) -> named_struct('at', greatest(a.at, s.end), 'out',"
        " if(s.start < a.at, a.out, concat(a.out, substring(text, cast(a.at + 1 AS int), cast(s.start - a.at AS int)),"
        f" {names}[s.kind]))), a -> concat(a.out, substring(text, cast(a.at + 1 AS int))))"
    )
    cleaned = joined.withColumn("text", F.when(F.col("_spans").isNotNull() & F.col("text").isNotNull(), walked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = F.col("_spans").isNotNull() & F.col("text").isNotNull()
        cleaned = cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)
