"""Licence scans: an Aho-Corasick automaton over words, and licence expressions by shunting-yard.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. One automaton finds
all phrases, each between word boundaries, in one pass over the whole text. Behind an identifier tag
stands an expression of identifiers with and, or, with and parentheses: it goes as far in the line as
the next word can continue it, no further than a sentence, and further tags are looked for from there.

Labels are those of all phrases and identifiers found. The score is how much the licences ask for:
0 without any, else a quarter to one by the level of the strictest notice; within an expression
``or`` takes its laxest side, ``and`` its strictest, and ``with`` lowers a copyleft by a level.

Defined results: a null or empty text has no words and no labels; an expression that is missing
or left open (an operator without a right side, an open parenthesis) gives the label ``unparsed``; a
text of any length is scanned whole, in one task; repeated rows are scanned each; null keys and keys of
any kind stay what they are; an empty table gives no rows; other columns play no part, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that every scan has, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
    "boost software license": "bsl",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "cc0 1 0 universal": "public-domain",
    "common development and distribution license": "cddl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons zero": "public-domain",
    "do what the fuck you want to public license": "public-domain",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "gnu free documentation license": "gfdl",
    "gnu library general public license": "lgpl",
    "isc license": "isc",
    "microsoft public license": "ms-pl",
    "open data commons open database license": "odbl",
    "open software license": "osl",
    "python software foundation license": "psf",
    "server side public license": "sspl",
    "sil open font license": "ofl",
    "the artistic license": "artistic",
    "the unlicense": "public-domain",
    "universal permissive license": "upl",
    "zlib license": "zlib",
}
#: The beginnings of licence identifiers, in lower case, and their labels.
IDENTIFIERS = {
    "0bsd": "public-domain",
    "afl": "afl",
    "agpl": "agpl",
    "apache": "apache",
    "artistic": "artistic",
    "bsd": "bsd",
    "bsl": "bsl",
    "cc-by-nc": "cc-by-nc",
    "cc-by-nd": "cc-by-nd",
    "cc-by-sa": "cc-by-sa",
    "cc-by": "cc-by",
    "cc0": "public-domain",
    "cddl": "cddl",
    "epl": "epl",
    "eupl": "eupl",
    "gfdl": "gfdl",
    "gpl": "gpl",
    "isc": "isc",
    "lgpl": "lgpl",
    "mit": "mit",
    "mpl": "mpl",
    "ms-pl": "ms-pl",
    "ncsa": "ncsa",
    "odbl": "odbl",
    "ofl": "ofl",
    "osl": "osl",
    "postgresql": "postgresql",
    "psf": "psf",
    "python": "psf",
    "sspl": "sspl",
    "unlicense": "public-domain",
    "upl": "upl",
    "wtfpl": "public-domain",
    "zlib": "zlib",
}
#: How much a label asks for: 0 nothing, 1 a notice, 2 its own files, 3 the whole work.
LEVELS = {
    "public-domain": 0,
    "mit": 1,
    "isc": 1,
    "bsd": 1,
    "apache": 1,
    "cc-by": 1,
    "afl": 1,
    "artistic": 1,
    "bsl": 1,
    "ms-pl": 1,
    "ncsa": 1,
    "ofl": 1,
    "postgresql": 1,
    "psf": 1,
    "upl": 1,
    "zlib": 1,
    "mpl": 2,
    "lgpl": 2,
    "cc-by-sa": 2,
    "cddl": 2,
    "epl": 2,
    "eupl": 2,
    "odbl": 2,
    "cc-by-nc": 3,
    "cc-by-nd": 3,
    "gfdl": 3,
    "osl": 3,
    "sspl": 3,
    "gpl": 3,
    "agpl": 3,
    "proprietary": 3,
    "unparsed": 3,
}
TAG = "spdx license identifier"
BINDS = {"or": 1, "and": 2, "with": 3}
#: Bytes of UTF-8 as they stand in words: capitals small, other ASCII signs blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TAGGED = re.compile("spdx-license-identifier[ \t]*:[ \t]*", re.IGNORECASE | re.ASCII)
_LINE = re.compile("[^\r\n]*")
#: Signs behind which no expression goes on.
_STOP = re.compile("[.,;:!?]")
#: An identifier starts with a letter or digit and does not end with a full stop or hyphen.
_TOKEN = re.compile(r"[()]|[A-Za-z0-9](?:[A-Za-z0-9.+\-]*[A-Za-z0-9+])?")


def identified(identifier: str) -> str:
    """Label of a licence identifier; its own lower-case form where none is known."""
    name = identifier.lower()
    best = max((k for k in IDENTIFIERS if name == k or name.startswith((k + "-", k + "+"))), key=len, default=None)
    return IDENTIFIERS[best] if best else name


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: the tokens of an expression in postfix order. ValueError if it isn't one."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # whether an identifier or "(" must come next
    for token in tokens:
        low = token.lower()
        if token == "(":
            if not operand:
                raise ValueError("( after an identifier")
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if operand or not held:
                raise ValueError("unexpected )")
            held.pop()
        elif low in BINDS:
            if operand:
                raise ValueError(f"{token} without a left side")
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        else:
            if not operand:
                raise ValueError(f"{token} after an identifier")
            out.append(token)
            operand = False
    if operand or "(" in held:
        raise ValueError("it ends too soon")
    return out + held[::-1]


def evaluate(expression: str) -> tuple[frozenset[str], int]:
    """Labels and level of an expression."""
    stack: list[tuple[frozenset[str], int]] = []
    try:
        order = postfix(_TOKEN.findall(expression))
    except ValueError:
        return frozenset({"unparsed"}), LEVELS["unparsed"]
    for token in order:
        if token not in BINDS:
            label = identified(token)
            stack.append((frozenset({label}), LEVELS.get(label, 3)))
            continue
        (b, high), (a, low) = stack.pop(), stack.pop()
        if token == "with":  # the right side is an exception, no licence
            stack.append((a, max(0, low - 1) if low >= 2 else low))
        else:
            stack.append((a | b, (min if token == "or" else max)(low, high)))
    return stack[0]


def tagged_expressions(text: str) -> list[str]:
    """The expression behind each tag, up to the first token that cannot continue it."""
    out, at = [], 0
    while tag := _TAGGED.search(text, at):
        start = at = tag.end()
        operand, deep = True, 0
        for token in _TOKEN.finditer(text, start, _LINE.match(text, start).end()):
            low = token[0].lower()
            if at > start and _STOP.search(text, at, token.start()):
                break
            if low == "spdx-license-identifier" or (low == ")" and not deep) or operand != (low == "(" or low not in (")", *BINDS)):
                break
            deep += (low == "(") - (low == ")")
            operand = low == "(" or low in BINDS
            at = token.end()
        out.append(text[start:at])
    return out


_built = None


def automaton():
    global _built
    if _built is None:
        import ahocorasick

        _built = ahocorasick.Automaton()
        for phrase, label in [*BASE.items(), *NOTICES.items(), (TAG, "")]:
            _built.add_word(f" {phrase} ", (label, phrase.count(" ") + 1, phrase in BASE))
        _built.make_automaton()
    return _built


def scan_text(text: str | None) -> tuple[int, list[tuple[int, int, str, bool]], list[str]]:
    """Words; spans (first word, words, label, whether a base phrase) in order; expressions."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    line = b" " + b" ".join(words) + b" "
    spans, tagged, seen, blanks = [], False, 0, 0
    for end, (label, n, base) in automaton().iter(line.decode("latin-1")):
        blanks += line.count(b" ", seen, end + 1)
        seen = end + 1
        if label:
            spans.append((blanks - 1 - n, n, label, base))
        else:
            tagged = True
    return len(words), sorted(spans), tagged_expressions(text) if tagged else []


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each document: the key, n_words, spans, expressions, labels, and score."""
    spans = "array<struct<first_word:bigint,words:bigint,label:string,base:boolean>>"
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = pa.list_(pa.string())
        shown = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))
        names, kinds = ["k_", "n_words", "spans", "expressions", "labels", "score"], [pa.int64(), shown, words, words, pa.float64()]
        for batch in batches:
            rows = []
            for body in batch.column(1).to_pylist():
                n, found, expressions = scan_text(body)
                parsed = [evaluate(x) for x in expressions]
                labels = {s[2] for s in found}.union(*(x for x, _ in parsed))
                levels = [LEVELS[s[2]] for s in found] + [level for _, level in parsed]
                listed = [{"first_word": a, "words": b, "label": c, "base": d} for a, b, c, d in found]
                rows.append((n, listed, expressions, sorted(labels), (1 + max(levels)) / 4 if levels else 0.0))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]], names=names)

    made = docs.select(F.col(key).alias("k_"), F.col(text).alias("t_")).mapInArrow(run, f"k_ {kind}, n_words long, spans {spans}, expressions array<string>, labels array<string>, score double")
    return made.withColumnRenamed("k_", key)


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The scan as plain columns: base places, their smallest and largest start, labels joined."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first_word"])
    return scanned.select(
        key, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda s: s["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )
