"""License scans: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser evaluates expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Phrases of the base scan: words that stand consecutively, and the label that they give.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notice phrases that the method knows besides.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit", "redistribution and use in source and binary forms": "bsd", "bsd license": "bsd", "isc license": "isc",
    "creative commons attribution": "cc-by", "this is free and unencumbered software released into the public domain": "unlicense", "all rights reserved": "proprietary",
}
#: Prefixes of licence identifiers, the longest match first, with label and permissiveness.
FAMILIES = {
    "mit": ("mit", 1.0), "apache": ("apache", 0.9), "bsd": ("bsd", 1.0), "isc": ("isc", 1.0), "unlicense": ("unlicense", 1.0), "0bsd": ("bsd", 1.0), "cc0": ("cc0", 1.0), "cc-by-sa": ("cc-by-sa", 0.5),
    "cc-by-nc": ("cc-by-nc", 0.1), "cc-by": ("cc-by", 0.8), "mpl": ("mpl", 0.6), "epl": ("epl", 0.6), "lgpl": ("lgpl", 0.5), "agpl": ("agpl", 0.1), "gpl": ("gpl", 0.3), "proprietary": ("proprietary", 0.0),
}
#: What stands before a licence expression, in any case; the expression ends with the line.
TAGS = ("spdx-license-identifier:", "spdx-license-expression:", "license-identifier:", "license-expression:", "licence-identifier:", "licence-expression:")
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"

_WORDS = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Parsed:
    """An expression's licence labels, its permissiveness (``or``: the best part, ``and``: the worst) and its canonical text."""

    labels: frozenset[str]
    score: float
    text: str


def identifier(name: str) -> Parsed | None:
    low = name.lower().rstrip("+")
    for prefix in sorted(FAMILIES, key=len, reverse=True):
        if low == prefix or low.startswith((f"{prefix}-", f"{prefix}_")) or low.startswith(prefix) and low[len(prefix) : len(prefix) + 1].isdigit():
            label, score = FAMILIES[prefix]
            return Parsed(frozenset([label]), score, low)
    return None


def parse_expression(text: str) -> Parsed | None:
    """Value of a licence expression by shunting yard; ``with`` binds closest, then ``and``, then ``or``.

    The longest well-formed beginning counts, since prose may follow a tag; unknown identifiers make a part of score 0 with
    no label.  None where no beginning is an expression with a known licence.
    """
    tokens = text.replace("(", " ( ").replace(")", " ) ").split()
    output: list[Parsed] = []
    operators: list[str] = []
    depth, operand, best = 0, True, None

    def reduce() -> None:
        op, right, left = operators.pop(), output.pop(), output.pop()
        if op == "with":
            output.append(Parsed(left.labels, left.score, f"{left.text} with {right.text}"))
        else:
            output.append(Parsed(left.labels | right.labels, (max if op == "or" else min)(left.score, right.score), f"({left.text} {op} {right.text})"))

    def value() -> Parsed:
        kept = list(output), list(operators)
        while operators:
            reduce()
        out = output[-1]
        output[:], operators[:] = kept
        return out

    for token in tokens:
        low = token.lower()
        if operand and token == "(":
            operators.append("(")
            depth += 1
        elif operand and low not in _PRECEDENCE and token != ")":
            ends = token.rstrip(".,;:*/")
            if not ends:
                break
            known = identifier(ends)
            if known is None and not (operators and operators[-1] == "with") and not any(c in ends for c in "-0123456789"):
                break
            output.append(known or Parsed(frozenset(), 0.0, ends.lower()))
            operand = False
            if depth == 0:
                best = value()
            if ends != token:
                break
        elif not operand and token == ")" and depth:
            while operators[-1] != "(":
                reduce()
            operators.pop()
            depth -= 1
            if depth == 0:
                best = value()
        elif not operand and low in _PRECEDENCE:
            while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= _PRECEDENCE[low]:
                reduce()
            operators.append(low)
            operand = True
        else:
            break
    return best if best and best.labels else None


class Scanner:
    """Automata over whole texts: one of phrases over the words joined by single blanks, each phrase with a blank on both sides, and one
    of identifier tags over the text itself in lower case."""

    def __init__(self) -> None:
        import ahocorasick

        self.words, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.tags.make_automaton()
        for phrase in {**NOTICE_PHRASES, **BASE_PHRASES}:
            self.words.add_word(f" {phrase} ", phrase)
        self.words.make_automaton()

    def scan(self, text: str | None) -> tuple:
        data = (text or "").encode("utf-8", "surrogatepass")
        found = data.translate(_WORDS).split()
        line = b" ".join([b"", *found, b""]).decode("latin-1")
        n_base, starts, base, labels = 0, [], set(), set()
        count, upto = -1, 0  # blanks before the place last looked at
        hits = sorted((end - len(p) - 1, p) for end, p in self.words.iter(line)) if found else []
        for start, phrase in hits:
            if phrase not in BASE_PHRASES:
                labels.add(NOTICE_PHRASES[phrase])
                continue
            count += line.count(" ", upto, start + 1)
            upto = start + 1
            n_base += 1
            starts.append(count)
            base.add(BASE_PHRASES[phrase])
        scores, expressions = [], []
        for begin in sorted({end + 1 for end, _ in self.tags.iter(data.translate(_LOWER).decode("latin-1"))}):
            end = data.find(b"\n", begin)
            if parsed := parse_expression(data[begin : end if end >= 0 else len(data)].decode("utf-8", "replace")):
                labels |= parsed.labels
                scores.append(parsed.score)
                expressions.append(parsed.text)
        labels |= base
        scores += [dict(FAMILIES.values())[x] for x in base | {NOTICE_PHRASES[p] for _, p in hits if p in NOTICE_PHRASES}]
        score = min(scores, default=0.0)
        return len(found), n_base, min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), float(score), expressions


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id and text are read): words, base phrase places, labels, evaluated expressions.

    ``score`` is the least permissiveness among what was found (0 to 1), 0 where nothing was.  Null text counts as empty:
    no words, no labels, null first_word and last_word.  Lines of any length are read whole.  Repeated rows are judged each; an
    empty table gives no rows; other columns, whatever their names, are not read.
    """

    def run(batches: Iterator) -> Iterator:
        scanner = Scanner()
        for batch in batches:
            rows = [(i, *scanner.scan(t)) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for t in (t.as_py(),)]
            yield pa_batch(rows)

    def pa_batch(rows: list[tuple]):
        import pyarrow as pa

        kinds = {"string": pa.string(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
        fields = [(n, kinds.get(k, pa.int64())) for n, k in (f.split(" ") for f in SCHEMA.split(", "))]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
        return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
