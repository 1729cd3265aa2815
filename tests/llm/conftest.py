"""Small document tables with every odd case."""

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, h long, _row int"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def texts():
    base = prose(1, 200)
    near = base.split()
    near[100] = "changed"
    out = [prose(i, 40 + i) for i in range(2, 40)]
    out += [base, base, " ".join(near), base.upper(), None, "", "   ", "\n\n", "one", "one two", "one two", "a b c d e", "a b c d e"]
    out += ["word " * 30, "x́ ÀÉ ſ ẞ Σ 日本語 🙂 é", "The MIT License and the mit-license; GNU General Public License", prose(99, 9000)]
    out += ["SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\ncode", "## $$ %% " * 20, "line one\nline one\nline two\n" * 3]
    return out


@pytest.fixture(scope="session")
def rows():
    made = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or ""), "x", "y", i, 7) for i, t in enumerate(texts())]
    return made + [made[3], made[3], (None, "a null key", "en", "s0", 1, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
