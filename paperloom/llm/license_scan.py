"""License scans by a generalised suffix automaton of license templates (operator 8).

Texts are A-Z lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Base: places where the words of a
phrase of BASE stand consecutively. The method streams the words through a suffix automaton of all templates' words:
at every word its state and length (the matching statistics), with the states up the suffix links, give for every
place of every template the longest passage that ends at both. Passages of MIN_MATCH words or more that can't be made
longer are matches.

Matches of a template are chained in the order of the text and of the template, at most GAP words apart in the text;
where a match overlaps the one before it, in the text or in the template, its head is cut off. The best chain by
words covered is found by dynamic programming, and its share of the template's words is the coverage. A coverage of
MIN_COVERAGE or more, by a chain that holds the template's phrases each within one match, adds the template's label.
A template of fewer than MIN_MATCH words is found where all its words stand consecutively, also within a longer
passage. The score is the best coverage of any template, or 1 where a base phrase stands.

Work is one pass over words: words of no template end a match at once, and only runs of template words enter the
automaton. Memory follows one text and the templates, whatever the text's length. Defined cases: null text counts as
empty (no words, null first_word and last_word, empty labels, score 0). Of chains that cover as many words the one that
begins and ends first is the span. Rows that repeat are scanned alike; an empty table gives no rows. Other columns than
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_groups, texts_of
from .license_texts import TEMPLATES

MIN_MATCH, GAP, MIN_COVERAGE = 4, 12, 0.6
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TABLE).split()


class SuffixAutomaton:
    """Of several word sequences: states' transitions, suffix links and lengths, and where a state's words end."""

    def __init__(self, sequences: list[list[bytes]]):
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for k, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].add((k, i + 1))
        for v in sorted(range(1, len(self.step)), key=lambda v: -self.length[v]):
            self.ends[self.link[v]] |= self.ends[v]
        self.ends[0] = set()
        self.vocabulary = frozenset(w for words in sequences for w in words)

    def _add(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.step) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        clone = self._add(self.length[p] + 1, dict(self.step[q]), self.link[q])
        while p != -1 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if (q := self.step[last].get(w)) is not None:  # of an earlier sequence
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._add(self.length[last] + 1, {}, 0), last
        while p != -1 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """After each word: (state, length of the longest match that ends there)."""
        state = length = 0
        for w in words:
            while state and w not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            nxt = self.step[state].get(w)
            state, length = (nxt, length + 1) if nxt is not None else (0, 0)
            yield state, length


class Match(NamedTuple):
    template: int
    at: int  # in the text
    of: int  # in the template
    n: int


class Scanner:
    """The compiled base phrases and templates; made once for a task."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.labels = [t[0] for t in templates]
        self.sequences = [words_of(t[1].encode()) for t in templates]
        self.phrases = [[words_of(p.encode()) for p in t[2]] for t in templates]
        self.automaton = SuffixAutomaton(self.sequences)
        self.least = min((min(MIN_MATCH, len(s)) for s in self.sequences if s), default=MIN_MATCH)
        self.short = self._short()
        self.ending = [self._ending(v) for v in range(len(self.automaton.link))]
        self.base = [(words_of(p.encode()), label) for p, label in base.items()]
        self.first = {p[0] for p, _ in self.base}
        self.known = self.automaton.vocabulary | self.first

    def _ending(self, v: int) -> list[tuple[int, int, int]]:
        """(template, end in it, length; 0: the match's own) of the passages that end where state v does, each once."""
        out, seen, a = [], set(), self.automaton
        at, length = v, 0
        while at > 0 and (length == 0 or length >= MIN_MATCH):
            new = a.ends[at] - seen
            out += [(k, stop, length) for k, stop in sorted(new) if len(self.sequences[k]) >= MIN_MATCH]
            seen |= new
            at = a.link[at]
            length = a.length[at] if at > 0 else 0
        return out

    def _short(self) -> dict[int, list[tuple[int, int]]]:
        """The states whose words end with a whole template of fewer than MIN_MATCH words: (template, its words)."""
        own: dict[int, list[tuple[int, int]]] = {}
        for k, s in enumerate(self.sequences):
            if 0 < len(s) < MIN_MATCH:
                *_, (state, n) = self.automaton.statistics(s)
                own.setdefault(state, []).append((k, n))
        out: dict[int, list[tuple[int, int]]] = {}
        for v in range(len(self.automaton.link)) if own else ():
            up, found = v, []
            while up > 0:
                found += own.get(up, [])
                up = self.automaton.link[up]
            if found:
                out[v] = found
        return out

    def base_places(self, words: list[bytes], at: list[int]) -> list[tuple[int, str]]:
        return [(i, label) for i in at if words[i] in self.first for p, label in self.base if words[i : i + len(p)] == p]

    def matches(self, words: list[bytes], at: list[int]) -> list[Match]:
        """Passages of MIN_MATCH words or more that can't be made longer, and shorter templates whole. at: the places
        of template words, in order."""
        out, begin = [], 0
        while begin < len(at):
            end = begin + 1
            while end < len(at) and at[end] == at[end - 1] + 1:
                end += 1
            if end - begin >= self.least:
                lo, hi = at[begin], at[end - 1] + 1
                for i, (state, n) in enumerate(self.automaton.statistics(words[lo:hi]), lo + 1):
                    out += [Match(k, i - m, 0, m) for k, m in self.short.get(state, ()) if n >= m]
                    if n >= MIN_MATCH:
                        after = words[i] if i < hi else None
                        for k, stop, length in self.ending[state]:
                            m, s = length or n, self.sequences[k]
                            if stop == len(s) or s[stop] != after:
                                out.append(Match(k, i - m, stop - m, m))
            begin = end
        return out

    def chains(self, matches: list[Match]) -> dict[int, tuple[float, int, int, bool]]:
        """Of every template with a match the best chain: (coverage, first word, word after the last, whether it is
        enough for the label)."""
        own: dict[int, list[Match]] = {}
        for m in matches:
            own.setdefault(m.template, []).append(m)
        return {k: self._chain(k, sorted(ms, key=lambda m: (m.at, m.of))) for k, ms in own.items()}

    def _chain(self, k: int, matches: list[Match]) -> tuple[float, int, int, bool]:
        words, phrases = self.sequences[k], self.phrases[k]
        all_held = (1 << len(phrases)) - 1
        best: dict[int, tuple[int, int, int]] = {}  # by phrases held: words covered, less first word, less end
        near: list[tuple[int, int, dict[int, tuple[int, int]]]] = []  # ends in text and template; by phrases covered and -start
        for m in matches:
            near = [c for c in near if m.at - c[0] <= GAP]
            part, held = words[m.of : m.of + m.n], 0
            for bit, p in enumerate(phrases):
                if any(part[i : i + len(p)] == p for i in range(len(part) - len(p) + 1)):
                    held |= 1 << bit
            here = {held: (m.n, -m.at)}
            for text_end, template_end, chains in near:
                cut = max(0, text_end - m.at, template_end - m.of)
                if cut < m.n and m.at + cut - text_end <= GAP:
                    for mask, (covered, start) in chains.items():
                        now = (covered + m.n - cut, start)
                        if now > here.get(mask | held, (0, 0)):
                            here[mask | held] = now
            near.append((m.at + m.n, m.of + m.n, here))
            for mask, (covered, start) in here.items():
                best[mask] = max(best.get(mask, (0, 0, 0)), (covered, start, -(m.at + m.n)))
        covered, start, end = max(best.values())
        enough = best.get(all_held, (0, 0, 0))
        if enough[0] >= MIN_COVERAGE * len(words):  # the span is that of the label's chain
            return covered / len(words), -enough[1], -enough[2], True
        return covered / len(words), -start, -end, False

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words, known = words_of(text), self.known
        at = [i for i, w in enumerate(words) if w in known]
        base = self.base_places(words, at)
        vocabulary = self.automaton.vocabulary
        found = self.chains(self.matches(words, [i for i in at if words[i] in vocabulary]))
        own = {label for _, label in base}
        labels = own | {self.labels[k] for k, (*_, enough) in found.items() if enough}
        score = max([1.0 if base else 0.0, *(share for share, *_ in found.values())])
        places = [i for i, _ in base]
        return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), score

    def spans(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """(label, coverage, first word, word after the last) of every template found."""
        words, vocabulary = words_of(text), self.automaton.vocabulary
        found = self.chains(self.matches(words, [i for i, w in enumerate(words) if w in vocabulary]))
        return [(self.labels[k], *x[:3]) for k, x in sorted(found.items()) if x[3]]


def license_scan(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """The report of SCHEMA: a row for every row of docs, in one pass without a shuffle."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        for whole in batches:
            for batch in row_groups(whole):
                found = list(zip(*map(scanner.scan, texts_of(batch)), strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").split(", "))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, SCHEMA)
