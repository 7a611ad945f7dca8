"""Licence scan with ordered signature rules.

An Aho-Corasick pass over the lower-cased text finds which words of keywords it holds.  In a text
that holds those of a rule, white space is folded, with what opens a comment line after a line break, so wrapped
phrases are found (spans are those of the text itself); a second pass finds the whole keywords, and only
rules with all of them present run their regex.  Detections are taken in the
order of priority, then length, then place, and one that lies inside a detection
already taken is suppressed, so "GPL version 3 or later" hides the "GPL version 3"
in it.  Beside the rules, fixed phrases are counted over words.

Texts are handled one at a time inside Arrow batches: no shuffle, no state, whole
texts; time grows in proportion to a text's length and its matches.  Defined results: an empty table
gives no rows; a null text counts as empty; an empty one has no words, no
labels, null places and score 0; ``score`` is the best detection's priority / 100,
at least 0.5 where a base phrase stands; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, map_batches
from .license_rules import Rule, rules

#: Fixed phrases and the labels they stand for.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: A-Z to a-z; every other ASCII character that is neither a digit nor a-z to a space.
_FOLD = bytes(c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

#: White space that is not one plain space, and comment leaders, which count after a line break.
_WRAP = re.compile(r"(?:[^\S ]| (?=\s))\s*")
_LEADERS = re.compile(r"(?:(?://+|/?\*+/?|#+|;+|--+|%+|>+|!+|dnl\b)\s*)+")


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    label: str
    priority: int


class Scanner:
    """The compiled rules; built once per Python worker."""

    def __init__(self, table: list[Rule] | None = None):
        import ahocorasick

        self.rules = table if table is not None else rules()
        self._compiled: dict[int, re.Pattern] = {}
        # a keyword's longest word stands in the text however the keyword is wrapped
        self._words = _Gate([[max(reversed(k.split()), key=len) for k in r.keywords] for r in self.rules], ahocorasick)
        self._keywords = _Gate([list(r.keywords) for r in self.rules], ahocorasick)

    def detect(self, lowered: str) -> list[Detection]:
        """What the rules find, overlaps resolved, in the order of the text."""
        if not self._words.due(lowered):
            return []
        found: list[Detection] = []
        lowered, places, shifts = unwrap(lowered)
        for n in self._keywords.due(lowered):
            rule = self.rules[n]
            pattern = self._compiled.get(n) or self._compiled.setdefault(n, rule.compiled())
            for m in pattern.finditer(lowered):
                if m.end() > m.start():
                    start = m.start() + shifts[bisect_right(places, m.start()) - 1]
                    end = m.end() + shifts[bisect_right(places, m.end() - 1) - 1]
                    found.append(Detection(start, end, rule.label or m.group(1).rstrip(".-"), rule.priority))
        return resolve(found)


class _Gate:
    """Which rules have all their strings in a text: one Aho-Corasick pass."""

    def __init__(self, needs: list[list[str]], ahocorasick):
        number = {k: i for i, k in enumerate(sorted({k for need in needs for k in need}))}
        self._needs = [frozenset(number[k] for k in need) for need in needs]
        rarity = {i: (-len(k), k) for k, i in number.items()}
        self._by_rarest: dict[int, list[int]] = {}
        for n, need in enumerate(self._needs):
            self._by_rarest.setdefault(min(need, key=rarity.__getitem__), []).append(n)
        self._automaton = ahocorasick.Automaton()
        for k, i in number.items():
            self._automaton.add_word(k, i)
        self._automaton.make_automaton()

    def due(self, text: str) -> list[int]:
        have = {i for _, i in self._automaton.iter(text)}
        return sorted(n for k in have for n in self._by_rarest.get(k, ()) if self._needs[n] <= have)


def unwrap(text: str) -> tuple[str, list[int], list[int]]:
    """The text with white space folded, and from which places on it is shifted by how much."""
    parts, places, shifts = [], [0], [0]
    done = size = 0
    for m in _WRAP.finditer(text):
        end = m.end()
        run = m.group()
        if "\n" in run or "\r" in run:
            lead = _LEADERS.match(text, end)
            end = lead.end() if lead else end
        elif run == " ":
            continue
        if m.start() < done:
            continue  # white space inside leaders
        parts += (text[done : m.start()], " ")
        size += m.start() - done + 1
        done = end
        if done - size != shifts[-1]:
            places.append(size)
            shifts.append(done - size)
    return "".join([*parts, text[done:]]), places, shifts


def resolve(found: list[Detection]) -> list[Detection]:
    """Drop each detection whose interval lies inside one that goes before it (higher
    priority, then longer, then first by label); one sweep per priority.

    What lies inside a dropped detection lies inside the one that dropped it too, so every
    detection may be compared with all that go before it, dropped or not.
    """
    found = sorted(found, key=lambda d: (d.start, -d.end, d.label))
    above: list[tuple[list[int], list[int]]] = []  # of each higher priority: starts, and the largest end up to there
    taken: list[Detection] = []
    for priority in sorted({d.priority for d in found}, reverse=True):
        starts, ends, reach = [], [], -1
        for d in found:
            if d.priority != priority:
                continue
            if reach < d.end and not any(_reach(s, e, d.start) >= d.end for s, e in above):
                taken.append(d)
            reach = max(reach, d.end)
            starts.append(d.start)
            ends.append(reach)
        above.append((starts, ends))
    # a long detection of lower priority may still enclose a kept one of the same label: keep one
    out, reaches = [], {}
    for d in sorted(taken, key=lambda d: (d.start, -d.end, d.label)):
        if reaches.get(d.label, -1) < d.end:
            out.append(d)
            reaches[d.label] = d.end
    return sorted(out, key=lambda d: (d.start, d.end, d.label))


def _reach(starts: list[int], ends: list[int], start: int) -> int:
    n = bisect_right(starts, start)
    return ends[n - 1] if n else -1


def base_places(text: bytes, phrases: dict[str, str] = BASE_PHRASES) -> tuple[int, list[tuple[int, str]]]:
    """Number of words, and (first word's index, label) of each place of a phrase."""
    folded = text.translate(_FOLD)
    words = folded.split()
    places: list[tuple[int, str]] = []
    joined = None
    for phrase, label in phrases.items():
        if any(w not in folded for w in phrase.encode().split()):
            continue
        joined = joined or b" " + b" ".join(words) + b" "
        needle = b" " + phrase.encode() + b" "
        at, done, word = joined.find(needle), 0, 0
        while at >= 0:
            word += joined.count(b" ", done, at)
            done = at
            places.append((word, label))
            at = joined.find(needle, at + 1)
    return len(words), places


_SCANNER: Scanner | None = None


def scanner() -> Scanner:
    global _SCANNER
    if _SCANNER is None:
        _SCANNER = Scanner()
    return _SCANNER


SCHEMA = (
    "id {id}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
    "detections array<struct<start:int,end:int,label:string,priority:int>>, score double"
)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: words, places of the base phrases, detections and labels.

    ``detections`` has code-point spans in the text; repeated rows give repeated rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        engine, rows = scanner(), []
        for raw in bytes_of(batch.column(1)):
            n_words, places = base_places(raw)
            # ASCII letters only, so that spans stay those of the text itself
            found = engine.detect(raw.lower().decode("utf-8", "replace"))
            base = sorted({label for _, label in places})
            labels = sorted({*base, *(d.label for d in found)})
            starts = [i for i, _ in places]
            score = max([0.0, 0.5 * bool(places), *(d.priority / 100 for d in found)])
            rows.append((n_words, len(places), min(starts, default=None), max(starts, default=None), base, labels, [d.__dict__ for d in found], score))
        long, strings = pa.int64(), pa.list_(pa.string())
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("priority", pa.int32())]))
        types = (long, long, long, long, strings, strings, span, pa.float64())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "detections", "score"]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(source, run, SCHEMA.format(id=source.schema["id"].dataType.simpleString()))
