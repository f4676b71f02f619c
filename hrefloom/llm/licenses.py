"""Licence scans by matching statistics over a generalised suffix automaton.

The automaton holds every run of words of every template; it is built once
per worker and its size depends on the templates alone.  The words of a text
stream through it: after each word it knows the longest run ending there that
some template contains.  Where such a run can't be made longer and has
``LEAST_MATCH`` words, it is a match.  A match may stand for several places of
a template, where the template repeats itself; matches that follow each other in
the text and, by one of their places, in the template are chained, each with the
predecessor that has covered most.  A chain that covers enough of its template
is a span with that template's label.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from hrefloom.llm.license_texts import TEMPLATES

LEAST_MATCH = 4
# words of text that may stand between two matches of a chain
GAP = 12
# share of a template that a chain must cover
COVERED = 0.8

# words are runs of digits, letters and anything beyond ASCII; A-Z are lowered
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
# The phrases of the base labels.
PHRASES = (("mit", (b"mit", b"license")), ("apache", (b"apache", b"license")), ("gpl", (b"general", b"public", b"license")))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """All runs of words of several templates."""

    def __init__(self, templates=TEMPLATES, least: int = LEAST_MATCH):
        self.labels = [label for label, _ in templates]
        texts = [words_of(text) for _, text in templates]
        self.sizes = [len(t) for t in texts]
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        # per state of ``least`` words or more: (template, end) of every run that it stands for
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, words in enumerate(texts):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)))
                self.ends[last].add((t, at + 1))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            above = self.link[state]
            # shorter runs are never matches, and stand in too many places
            if self.length[above] >= least:
                self.ends[above] |= self.ends[state]

    def _new(self, length: int, transitions: dict[int, int], link: int) -> int:
        self.next.append(transitions)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of exactly ``length[p] + 1`` words that ``q`` stands for as well."""
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # an earlier template has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def matches(self, words: list[bytes], least: int = LEAST_MATCH) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the runs of ``least`` words or more that can't be made longer."""
        state, size = 0, 0
        following, link, length = self.next, self.link, self.length
        at = 0
        for at, word in enumerate(map(self.ids.get, words)):
            if word is None:
                if size >= least:
                    yield at, size, state
                state = size = 0
                continue
            to = following[state].get(word)
            if to is None:
                if size >= least:
                    yield at, size, state
                while state and word not in following[state]:
                    state = link[state]
                    size = length[state]
                to = following[state].get(word)
                if to is None:
                    state = size = 0
                    continue
            state = to
            size += 1
        if size >= least:
            yield len(words), size, state


@dataclass
class Span:
    label: str
    template: int
    start: int
    end: int
    covered: int
    coverage: float


@dataclass
class _Link:
    """A match at one place of a template, with the best chain that it ends."""

    start: int  # of the chain in the text
    end: int
    t_end: int
    covered: int


def _best(links: list[_Link]) -> list[_Link]:
    """Chains that cover most, apart from each other in the text; linear but for a sort."""
    out: list[_Link] = []
    starts: list[int] = []
    for link in sorted(links, key=lambda x: (-x.covered, x.start, x.end, x.t_end)):
        at = bisect_left(starts, link.end)
        # the chain before this place must end where this one starts
        if (at == 0 or out[at - 1].end <= link.start) and (at == len(out) or link.end <= out[at].start):
            out.insert(at, link)
            starts.insert(at, link.start)
    return out


def spans(automaton: SuffixAutomaton, words: list[bytes]) -> list[Span]:
    """The chains of matches of a text: for each template those that cover most, apart from each other.

    A match goes on with a chain of its template if it ends after it, starts
    within ``GAP`` words of its end, and lies forward in the template; of those
    chains the one that has covered most is taken.  Only chains within the gap
    are looked at, and a template holds a run a fixed number of times, so the
    work is linear in the matches.
    """
    live: dict[int, list[_Link]] = {}  # template -> links that a match may still go on with
    done: dict[int, list[_Link]] = {}  # template -> links of the same stretch
    found: list[Span] = []

    def close(t: int) -> None:
        live.pop(t)
        for x in _best(done.pop(t)):
            found.append(Span(automaton.labels[t], t, x.start, x.end, x.covered, min(1.0, x.covered / automaton.sizes[t])))

    for end, size, state in automaton.matches(words):
        places: dict[int, list[int]] = {}
        for t, t_end in automaton.ends[state]:
            places.setdefault(t, []).append(t_end)
        for t, t_ends in places.items():
            near = [x for x in live.get(t, ()) if end - size - x.end <= GAP]
            if t in live and not near:
                close(t)
            fresh = []
            for t_end in sorted(t_ends):
                new = _Link(end - size, end, t_end, size)
                for x in near:
                    if x.end < end and x.t_end < t_end:
                        covered = x.covered + min(size, end - x.end, t_end - x.t_end)
                        if (covered, -x.start) > (new.covered, -new.start):
                            new = _Link(x.start, end, t_end, covered)
                fresh.append(new)
            live[t] = near + fresh
            done.setdefault(t, []).extend(fresh)
    for t in list(live):
        close(t)
    return sorted(found, key=lambda s: (s.start, s.end, s.template))


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand."""
    places = []
    for at, word in enumerate(words):
        if word == b"license":
            for label, phrase in PHRASES:
                start = at + 1 - len(phrase)
                if start >= 0 and tuple(words[start : at + 1]) == phrase:
                    places.append((start, label))
    return places


_SPAN = pa.struct([
    ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64()),
])
_FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.list_(pa.string())), ("spans", pa.list_(_SPAN)), ("score", pa.float64()),
]
SCAN_FIELDS = (
    "n_words BIGINT, n_base BIGINT, first_word BIGINT, last_word BIGINT, base_labels ARRAY<STRING>, "
    "spans ARRAY<STRUCT<label: STRING, start: BIGINT, end: BIGINT, covered: BIGINT, coverage: DOUBLE>>, score DOUBLE"
)


def scan_text(automaton: SuffixAutomaton, text: str | None, covered: float = COVERED) -> dict:
    words = words_of(text)
    places = base_places(words) if b"license" in words else []
    chains = spans(automaton, words)
    return {
        "n_words": len(words), "n_base": len(places),
        "first_word": min(places)[0] if places else None, "last_word": max(places)[0] if places else None,
        "base_labels": sorted({label for _, label in places}),
        "spans": [{"label": s.label, "start": s.start, "end": s.end, "covered": s.covered, "coverage": s.coverage} for s in chains if s.coverage >= covered],
        "score": max((s.coverage for s in chains), default=0.0),
    }


def scan_licenses(docs: DataFrame, templates=TEMPLATES, covered: float = COVERED) -> DataFrame:
    """``doc_id, text`` -> ``doc_id`` and ``SCAN_FIELDS``, a row per row, without a shuffle.

    A null text is an empty one: no words, no spans, score 0.  ``spans`` are
    word positions, end exclusive, and hold the chains that cover at least the
    share ``covered`` of their template; ``score`` is the best share of any
    chain.  Rows are independent: repeated rows get equal results.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton(templates)
        for b in batches:
            rows = [scan_text(automaton, t.as_py(), covered) for t in b.column(1)]
            columns = [pa.array([r[n] for r in rows], type=kind) for n, kind in _FIELDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *(n for n, _ in _FIELDS)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "cast(text AS string) AS text").mapInArrow(scan, f"doc_id {kind}, {SCAN_FIELDS}")
